"""Joins of what texts are cut into: the planner knows the source's few bytes only, and must not broadcast such tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

from lodegrain.operators import blocks, history, symbols
from lodegrain.operators.within import within
from lodegrain.plans import codebase, samples

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the corpus folder")


def broadcast(df):
    """The keys of the joins that broadcast a side."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan
    return {k for keys in re.findall(r"BroadcastHashJoin \[([^]]*)\]", plan) for k in re.findall(r"(\w+)#", keys)}


def test_dead_since_broadcasts_nothing(spark):
    dead = symbols.dead_symbols(codebase.files_of(spark, DATA))
    assert not broadcast(history.dead_since(dead, codebase._ages(spark, DATA), 30, F.lit(86400 * codebase.TODAY)))


def test_suppliers_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(codebase, "TASK_SUPPLIERS", 4)
    n = spark.read.parquet(f"{DATA}/supplier.parquet").count()
    assert codebase.suppliers(spark, DATA).rdd.getNumPartitions() == -(-n // 4) > 1
    assert codebase.suppliers(spark, DATA).distinct().count() == n


def test_scores_broadcast_no_texts(spark):
    assert not broadcast(blocks.complexity(samples.files_of(spark, DATA)))


def test_counts_are_worked_out_one_by_one(spark, monkeypatch):
    """No plan holds two detectors, and none broadcasts more than aliases of the root's three settings and pieces of needles that were measured."""
    parts = []
    monkeypatch.setattr(codebase, "written", lambda df: parts.append(df) or df)
    codebase._counts(codebase.files_of(spark, DATA))
    assert len(parts) == 11 and set().union(*map(broadcast, parts)) <= {"alias", "_piece"}


def test_many_needles_are_merged(spark, monkeypatch):
    needles, strings = spark.createDataFrame([("ab",), ("bcd",), ("zz",)], "n string"), spark.createDataFrame([("abcd",), ("xbcd",), (None,)], "s string")
    few = within(needles, strings, "n", "s")
    monkeypatch.setattr("lodegrain.operators.within.SENT_BYTES", 100)
    many = within(needles, strings, "n", "s")
    assert not broadcast(many) and "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == [("ab", "abcd"), ("bcd", "abcd"), ("bcd", "xbcd")]
