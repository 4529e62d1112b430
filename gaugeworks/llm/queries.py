"""The operators bound to the query contract: one query an operator, each over its
whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, decontaminate, hard_negatives, language_id, media, near_vectors, ngram_join, oracles, quality, ranked_search, separators, suffix_dedup, token_files, toxicity
from gaugeworks.llm.sampling import bucket_of

#: The operators' vocabularies; another folder with the same files may be named.
TOKENIZERS = None
FLAT_END_ID = 49407


def tokenizer_path(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fit_languages(docs: DataFrame) -> language_id.LanguageModel:
    """From the documents that are not held out."""
    return language_id.fit_language_model(docs.where(bucket_of(docs.doc_id, 3) != 1))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of the labels there are: poor quality, then toxic.  Documents whose
    crc32 modulo 5 is 0 are held out of the training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(bucket_of(F.col("doc_id"), 5) != 0).select("doc_id", (1 - F.col("quality")).alias("poor"), F.col("toxic").alias("toxicity"))
    found = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, ["poor", "toxicity"]))
    return found.select("doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "p_poor", "p_toxicity", "toxic")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), fit_languages(docs))
    return found.select("doc_id", (bucket_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), FLAT_END_ID)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    outputs = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return bpe.bpe_encode(docs, tokenizer_path("word_bpe_49k.json"), outputs=outputs).select("doc_id", *outputs)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(bucket_of(F.col("doc_id"), 4) != 2)
    found = quality.score_quality(docs, quality.fit_quality(docs, labels))
    return found.select("doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, manifest)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the vectors whose id is divisible by 50; every seventh id has its label
    turned to the next one first."""
    vectors = table(spark, sf_dir, "embeddings")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.select("vec_id", "embedding", turned.alias("label")), F.col("vec_id") % 50 == 0)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def queries():
    ops = (op1_toxicity, op2_language_id, op3_token_counts, op4_bpe, op5_suffix_dedup, op6_media_columns, op7_quality, op8_decontamination, op9_ngram_join, op10_token_files, op11_hard_negatives, op12_ranked_search, op13_near_vectors)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
