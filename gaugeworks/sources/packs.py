"""Language packs, a JSON object of texts by key in one file a locale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.catalogs import overlay, placeholders

# The key of a language's own name, what a locale's file may be called, and
# the locale that all others are held against.
NAME_KEY = "language.name"
FILE = r"^[a-z0-9_-]+\.json$"
BASE = "en"


def pack_entries(spark: SparkSession, folder: str) -> DataFrame:
    """(locale, file, key, value, fault): a row an entry of the packs of a folder; ``value``
    is null where it is no text.  A file that is not JSON, repeats a key or is no object has
    one row without a key and a ``fault``, and an empty object one with neither."""
    texts = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    fault = F.when(F.col("v").isNull(), "corrupt JSON").when(~F.startswith(kind, F.lit("OBJECT")), "root is not an object")
    read = texts.select(F.regexp_replace("file", r"\.json$", "").alias("locale"), "file", fault.alias("fault"), F.when(fault.isNull(), F.col("v")).alias("v"))
    each = read.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()).select("key", F.col("value").alias("held")))
    text = F.when(F.schema_of_variant("held") == "STRING", F.variant_get("held", "$", "string"))
    return each.select("locale", "file", "key", text.alias("value"), "fault")


def builtin_faults(entries: DataFrame) -> DataFrame:
    """(locale, fault, key) of built-in packs: what makes one unfit.  All must be whole and
    have the keys and placeholders of the base.  Files of other names are not read."""
    packs = entries.where(F.col("file").rlike(FILE))
    files = packs.where("fault is not null").select("locale", "fault", "key")
    kept = packs.where("key is not null")
    values = kept.where("value is null").select("locale", F.lit("value is no text").alias("fault"), "key")
    locales = packs.where("fault is null").select("locale").distinct()
    named = kept.where(f"key = '{NAME_KEY}' and value <> ''").select("locale")
    unnamed = locales.join(named, "locale", "left_anti").select("locale", F.lit("missing language name").alias("fault"), F.lit(NAME_KEY).alias("key"))
    base = kept.where(F.col("locale") == BASE).select("key", placeholders(F.col("value")).alias("__asked"))
    asked = locales.crossJoin(F.broadcast(base))  # as many rows as texts in all packs together
    both = asked.join(kept.select("locale", "key", "value", F.lit(True).alias("__own")), ["locale", "key"], "full")
    known = F.col("__asked").isNotNull()
    fault = F.when(F.col("__own").isNull(), "missing key").when(~known, "extra key").when(placeholders(F.col("value")) != F.col("__asked"), "placeholder mismatch")
    unlike = both.withColumn("fault", fault).where("fault is not null").select("locale", "fault", "key")
    none = entries.agg(F.count_if((F.col("file") == BASE + ".json")).alias("n")).where("n = 0").select(F.lit(BASE).alias("locale"), F.lit("missing base").alias("fault"), F.lit(None).cast("string").alias("key"))
    return files.unionByName(values).unionByName(unnamed).unionByName(unlike).unionByName(none)


def builtin_packs(entries: DataFrame) -> DataFrame:
    """(locale, key, value) of the built-in packs; any fault in them is an error."""
    fault = builtin_faults(entries).orderBy(F.col("fault") != "missing base", "locale", "fault", "key").first()
    if fault:
        raise ValueError(f"{fault.locale}: {fault.fault}" + (f" ({fault.key})" if fault.key else ""))
    return entries.where(F.col("file").rlike(FILE) & F.col("key").isNotNull()).select("locale", "key", "value")


def override_packs(entries: DataFrame, builtin: DataFrame) -> DataFrame:
    """(locale, key, value, reason) of users' packs: a row an entry, or a file that is passed
    over as a whole (no key), with the reason why it is; ``reason`` is null for what holds.
    The name of a language holds beside its texts."""
    base = builtin.where(F.col("locale") == BASE).select("key", placeholders(F.col("value")).alias("__asked"))
    named = F.col("key").eqNullSafe(NAME_KEY) & (F.coalesce("value", F.lit("")) != "")
    whole = entries.groupBy("file").agg(F.first("locale").alias("locale"), F.max("fault").alias("fault"), F.bool_or(named).alias("named"))
    skipped = F.when(~F.col("file").rlike(FILE), "invalid filename").when(F.col("fault").isNotNull(), F.col("fault")).when(~F.col("named"), "missing language name")
    files = whole.withColumn("skipped", skipped)
    refused = files.where("skipped is not null").select("locale", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.col("skipped").alias("reason"))
    fine = entries.where("key is not null").join(files.where("skipped is null").select("file"), "file", "left_semi").join(F.broadcast(base), "key", "left")
    name = F.col("key") == NAME_KEY
    reason = F.when(~name & F.col("__asked").isNull(), "unknown key").when(F.col("value").isNull(), "no text").when(~name & (placeholders(F.col("value")) != F.col("__asked")), "placeholder mismatch")
    return refused.unionByName(fine.select("locale", "key", "value", reason.alias("reason")))


def messages(builtin: DataFrame, overrides: DataFrame, locale: str) -> DataFrame:
    """(key, value) a locale shows: the user's text, else its own, else the base's."""
    base = builtin.where(F.col("locale") == BASE)
    layers = [overrides.where((F.col("locale") == locale) & F.col("reason").isNull() & F.col("key").isNotNull()), builtin.where(F.col("locale") == locale)]
    return overlay(base, layers, "key", "value")
