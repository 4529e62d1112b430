"""Operators for preparing training data for language models.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; :mod:`gaugeworks.llm.queries` binds them to the query contract.
"""
