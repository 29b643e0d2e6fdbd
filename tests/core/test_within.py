"""Substring joins by pieces: equal to trying every pair, without a plan that does."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodegrain.operators import config, imports
from lodegrain.operators.within import within


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_equal_trying_all(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcé_. ") for _ in range(rng.randint(0, 12))) for _ in range(150)] + [None, "", "x" * 200_000 + "needle", "🙂a🙂b"]
    needles = ["".join(rng.choice("abcé_.") for _ in range(rng.randint(0, 4))) for _ in range(80)] + [None, "", "needle", "🙂a🙂", "zzz"]
    n = spark.createDataFrame([(i % 2, x) for i, x in enumerate(needles)] * 2, "g int, n string")
    t = spark.createDataFrame([(i % 2, x) for i, x in enumerate(texts)], "g int, t string")
    got = sorted((r.g, r.n, r.t) for r in within(n, t, "n", "t", "g").collect())
    want = sorted({(i % 2, x, y) for i, x in enumerate(needles) for j, y in enumerate(texts) if i % 2 == j % 2 and x is not None and y is not None and x in y})
    assert got == want and len(got) > 300


def test_unmentioned_equals_trying_all(spark):
    """Keys of one and two characters, keys with white space, of white space alone, null and repeated keys, and clashing column names."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab.XY_ \n") for _ in range(rng.randint(0, 25))) for _ in range(60)] + [None, "", "two words\there"]
    keys = ["".join(rng.choice("ab.XYZ_") for _ in range(rng.randint(1, 5))) for _ in range(60)] + ["two words", "words\there", "wo wo", " ", "\t", "  \n ", "two words", None]
    k = spark.createDataFrame([(x, 1) for x in keys], "key string, _piece int")
    t = spark.createDataFrame([(x, 2) for x in texts], "content string, _word int")
    got = sorted((r.key or "") for r in config.unmentioned(k, t).collect())
    assert got == sorted((x or "") for x in keys if x is None or not any(y is not None and x in y for y in texts))
    assert config.unmentioned(k, t.where("false")).count() == len(keys) and config.unmentioned(k.where("false"), t).count() == 0


def test_unused_equals_trying_all(spark):
    rng = random.Random(3)
    name = lambda: "/".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3)))
    declared = [(rng.choice("np"), name(), i) for i in range(80)] + [("n", None, 90), (None, "a", 91)]
    used = [(rng.choice("np"), name()) for _ in range(25)] + [("n", None), (None, "a"), ("p", "a/")]
    serves = lambda d, u: None not in (d[0], d[1], u[0], u[1]) and d[0] == u[0] and (d[1] == u[1] or u[1].startswith(d[1] + "/") or u[1] in d[1])
    got = imports.unused(spark.createDataFrame(declared, "manager string, name string, i int"), spark.createDataFrame(used, "manager string, name string"))
    assert sorted(r.i for r in got.collect()) == sorted(d[2] for d in declared if not any(serves(d, u) for u in used))


@pytest.mark.parametrize("limit", ["10485760", "-1"])
def test_plans_try_no_pairs_and_read_texts_once(spark, tmp_path, limit):
    texts, keys = str(tmp_path / "texts"), str(tmp_path / "keys")
    spark.range(50).select(F.concat(F.lit("word"), "id").alias("content")).write.parquet(texts)
    spark.range(20).select(F.concat(F.lit("word1"), "id").alias("key")).write.parquet(keys)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        left = config.unmentioned(spark.read.parquet(keys), spark.read.parquet(texts))
        assert left.count() == 10
        left.collect()
        final = plan(left).split("== Initial Plan ==")[0]
        assert "NestedLoop" not in final and "Cartesian" not in final
        assert len(re.findall(r"FileScan parquet \[content", final)) == 1
        declared = spark.read.parquet(keys).select(F.lit("npm").alias("manager"), F.col("key").alias("name"))
        other = imports.unused(declared, spark.read.parquet(texts).select(F.lit("npm").alias("manager"), F.col("content").alias("name")))
        other.collect()
        assert "NestedLoop" not in plan(other) and "Cartesian" not in plan(other)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
