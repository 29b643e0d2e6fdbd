"""The registered queries over the smallest tables against their SQL, and the entry's guards."""

import collections
import importlib
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from lodegrain.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the corpus folder")


def counted(df):
    df = df.astype(object).where(df.notna(), None)
    key = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)
    return collections.Counter(tuple(map(key, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, tables, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), tables.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and counted(got) == counted(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "line", "name", "kind"] and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_parts(monkeypatch):
    for gone in ("corpus_pipeline", "lodegrain.llm", "lodegrain.llm.queries"):
        monkeypatch.setitem(sys.modules, gone, None)
    module = importlib.util.module_from_spec(spec := importlib.util.spec_from_file_location("entry_alone", entry.__file__))
    spec.loader.exec_module(module)
    assert set(module.queries()) == set(QUERIES)
