"""Measurement analytics on Spark: percentile scores, timeline sampling, size
prediction, candidate selection, corpus scoring and event folding."""

__version__ = "0.1.0"
