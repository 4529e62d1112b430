import hashlib

import corpus_pipeline as C
from pyspark.sql import functions as F

from gaugeworks.llm.queries import table

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = table(spark, DATA, "documents")
    bench = table(spark, DATA, "benchmark").select(F.col("text")).limit(1).first().text
    extra = spark.createDataFrame([(-1, None, "en", "s", None), (-2, "!!! 123", "en", "s", 7), (-3, bench, "en", "s", len(bench))], docs.schema)
    docs = docs.unionByName(extra).withColumn("hash", F.lit(7))
    docs = docs.withColumn("odd name", F.struct(F.lit(1).alias("a b"))).withColumn("REJECTED", F.lit("mine")).withColumn("__hash", F.lit(2)).withColumn("key", F.lit(3))
    columns, seen = docs.columns, [docs.count()]
    for name, stage in C.STAGES:
        docs = C.written(stage(spark, docs, DATA), name)
        assert docs.columns[: len(columns)] == columns
        seen.append(docs.count())
        if name == "language":
            assert docs.where("doc_id in (-1, -2)").count() == 0 and docs.where("doc_id = -3").count() == 1
    assert docs.where("doc_id = -3").count() == 0
    assert seen == sorted(seen, reverse=True) and seen[1] == seen[0] - 2 and seen[2] < seen[1] and seen[-1] == seen[-2] > 0
    assert docs.columns == [*columns, "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_empty_documents(spark):
    docs = table(spark, DATA, "documents").limit(0)
    for name, stage in C.STAGES:
        docs = C.written(stage(spark, docs, DATA), name)
    assert docs.count() == 0


def test_columns_named_like_the_models_keep_their_values(spark):
    docs = table(spark, DATA, "documents")
    docs = docs.withColumn("Score", F.concat(F.lit("s"), "doc_id")).withColumn("rejected", F.col("doc_id") * 2).withColumn("lang_pred", F.lit(True))
    kept = C.identify_language(spark, docs, DATA)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    rows = kept.collect()
    assert rows and all(r.Score == f"s{r.doc_id}" and r.rejected == 2 * r.doc_id and r.lang_pred is True for r in rows)


def test_run_gives_the_ids_and_leaves_one_table(spark):
    from gaugeworks.llm.cluster import filesystem, shared_root
    from pyarrow import fs

    where, path = filesystem(shared_root(spark))
    names = lambda: {f.base_name for f in where.get_file_info(fs.FileSelector(path))}
    before = names()
    rows = C.run(spark, DATA).collect()
    assert rows and all(len(r.ids.split()) == r.n_tokens and hashlib.sha256(r.ids.encode()).hexdigest() == r.ids_sha256 for r in rows)
    stages = {name for name, _ in C.STAGES}
    assert {n.rsplit("-", 1)[0] for n in names() - before} & stages == {"benchmark"}
