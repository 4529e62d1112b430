"""Small documents with the awkward cases every operator must take."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])
WORDS = "the of and ring stone über Élan a1 ü ñandú it's don't 7 42 Σίσυφος 漢字 end-of word".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice([".", ",", "!", "\n", "  "]) if rng.random() < 0.2 else "") for _ in range(n))


def awkward(seed=1, n=40):
    """(doc_id, text) with nulls, empty, wordless, short, very long, repeated and tied rows."""
    rng = random.Random(seed)
    rows = [(k, sentence(rng, rng.randint(1, 120))) for k in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "   \n"), (n + 3, "!!! ***"), (n + 4, "one"), (n + 5, "two words")]
    rows += [(n + 6, sentence(rng, 6000)), (n + 7, "x" * 5000), (n + 8, rows[0][1]), (n + 9, rows[0][1]), (3, rows[3][1]), (None, "no id here at all"), (-5, "negative id")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en" if k is None or k % 2 else "fr", "s", None if t is None else len(t)) for k, t in rows], SCHEMA)
