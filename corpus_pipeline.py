"""The corpus pipeline: language ID, near copies, repeated strings, benchmark passages,
token ids.  Every stage reads what the one before it kept, as Parquet.

All stages: rows with null ids are judged like others; long texts are treated whole; an
empty table gives an empty one; columns of other names are carried whatever they are
called, and only the last stage adds some.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import bpe, decontaminate, language_id, ngram_join, suffix_dedup
from gaugeworks.llm.cluster import discard, written
from gaugeworks.llm.queries import fit_languages, table, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the language model rejects go: null texts, texts without a letter,
    answers below its calibrated threshold, texts of too many subwords never trained.
    Repeated rows stay or go together.  Columns have other names meanwhile, so that none
    is taken for one of the model's."""
    own = [c if c == "text" else f"__{k}" for k, c in enumerate(docs.columns)]
    kept = language_id.identify(docs.toDF(*own), fit_languages(docs)).where("not rejected")
    return kept.select(*own).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, of repeated rows one.  Null texts
    and texts without a word are no copies of each other and all stay."""
    return ngram_join.drop_near_copies(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that begin anywhere else are cut out of the texts; where that
    changes a text, ``n_chars`` is its new length.  All rows stay; null texts stay null;
    longer texts that are equal lose everything and become empty."""
    return suffix_dedup.remove_repeats(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by ``benchmark`` go.  Null, empty and wordless texts stay;
    repeated rows stay or go together; an empty benchmark keeps all."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids (decimal, blank-joined), the ids' number and
    digest, and the digest of the decoded text.  Null texts count as empty; columns of
    these four names, in any case, are replaced; repeated rows are encoded each."""
    return bpe.bpe_encode(docs, tokenizer_path("word_bpe_49k.json"), outputs=["n_tokens", "ids", "ids_sha256", "decoded_sha256"])


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("repeats", remove_repeats),
    ("benchmark", drop_benchmark),
    ("encode", encode),
]

#: Near copies, trained models and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  A stage's table is deleted when the next one is
    written; the result reads the last one."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
            if last is not None:
                discard(last)
            last = docs
    return docs
