"""Configuration keys that no source mentions."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrain.functions.tables import merged
from lodegrain.functions.text import basename, lines_of
from lodegrain.operators.within import within

#: Files that declare keys.
ENV_FILE = r"^\.env(?:\.(?:example|sample|local|development|staging|production|test))?\z"
JSON_FILE = r"^(?:config|settings)(?:\.[^/]+)?\.json\z"
SOURCE_EXTS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", ".go", ".java", ".rb", ".rs", ".php", ".cs")


def _flat(value: object, prefix: str = "") -> list[tuple[str, str]]:
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in _flat(v, f"{prefix}.{k}" if prefix else k)]
    return [(prefix, value if isinstance(value, str) else json.dumps(value))] if prefix else []


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])))
def _json_keys(texts: pa.Array) -> pa.Array:
    """Dotted keys of JSON objects; lists are values; none for what is no JSON."""
    out = []
    for t in texts.to_pylist():
        try:
            out.append([{"key": k, "value": v} for k, v in _flat(json.loads(t))])
        except (ValueError, TypeError, RecursionError):
            out.append([])
    return pa.array(out, pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])))


def config_keys(files: DataFrame) -> DataFrame:
    """(key, value, declared_in): keys of environment files and root JSON configurations; the last file by path that declares a key counts."""
    env = lines_of(files.where(basename(F.col("path")).rlike(ENV_FILE))).withColumn("text", F.trim("text")).where("text <> '' and not startswith(text, '#') and instr(text, '=') > 1")
    env = env.select(F.trim(F.substring_index("text", "=", 1)).alias("key"), F.trim(F.expr("substring(text, instr(text, '=') + 1)")).alias("value"), F.col("path").alias("declared_in"), F.col("line").alias("ord"))
    found = files.where(F.col("path").rlike(JSON_FILE) & F.col("content").isNotNull()).select("path", F.posexplode(_json_keys("content")).alias("ord", "k"))
    keys = env.union(found.select("k.key", "k.value", F.col("path").alias("declared_in"), "ord"))
    return keys.groupBy("key").agg(F.max_by(F.struct("value", "declared_in"), F.struct("declared_in", "ord")).alias("d")).select("key", "d.*")


def unmentioned(keys: DataFrame, texts: DataFrame, key: str = "key", text: str = "content") -> DataFrame:
    """Rows of keys whose key is part of no text.

    A key without white space is part of a text if it is part of one of its words, so keys are looked up in the corpus's distinct words and texts are read once. Only
    where keys with white space exist are the texts read again: such a key is looked up by the longest part that has none, and compared with the texts that hold it.
    """
    wanted = keys.select(F.col(key).alias("_key")).where("_key is not null").distinct()
    used = texts.select(F.col(text).alias("_text")).where("_text is not null")
    words = F.explode(F.array_distinct(F.split("_text", r"\s+"))).alias("_word")
    spaced = F.col("_key").rlike(r"\s")
    found = within(wanted.where(~spaced), used.select(words), "_key", "_word").select("_key").distinct()
    if not wanted.where(spaced).isEmpty():
        part = F.element_at(F.array_sort(F.split("_key", r"\s+"), lambda a, b: F.length(b) - F.length(a)), 1)
        several = wanted.where(spaced).withColumn("_part", part)
        named = used.withColumn("_text_id", F.xxhash64("_text"))
        holds = merged(within(several, named.select(words), "_part", "_word"), named.select("_text_id", words), "_word").select("_text_id", "_part").distinct()
        met = merged(merged(holds, several, "_part"), named, "_text_id").where(F.contains(F.col("_text"), F.col("_key")))
        found = found.union(met.select("_key").distinct())
    return merged(keys, found, F.col(key) == F.col("_key"), "left_anti")


def unused_keys(files: DataFrame) -> DataFrame:
    """(key, value, declared_in): keys of two characters or more that no source file mentions; long values are cut at 60 characters."""
    value: Column = F.when(F.length("value") > 60, F.concat(F.substring("value", 1, 60), F.lit("..."))).otherwise(F.col("value"))
    return unmentioned(config_keys(files).where(F.length("key") >= 2), files.where(F.col("ext").isin(list(SOURCE_EXTS)))).withColumn("value", value)
