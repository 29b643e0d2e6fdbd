"""A language that a user adds is part of the definitions and of SQL."""

import re

import pytest
from pyspark.sql import functions as F

from lodegrain.operators import plugins, symbols
from lodegrain.sources.files import as_files


def read_lisp(text, ext):
    """(defun name ...) defines; (name ...) mentions."""
    if "broken" in text:
        raise ValueError("not balanced")
    at = lambda m: text.count("\n", 0, m.start())
    defined = [(m[1], "function", at(m) + 1, m.start(1) - (text.rfind("\n", 0, m.start()) + 1), None, True, at(m)) for m in re.finditer(r"\(defun (\w+)", text)]
    return defined, sorted({m[1] for m in re.finditer(r"\((\w+)", text)} - {"defun"})


@pytest.fixture
def lisp(spark):
    plugins.add(plugins.Plugin("lisp", (".lisp", ".py"), read_lisp))
    yield as_files(spark.createDataFrame([("a.lisp", "(defun used ())\n; // lodegrain-ignore\n(defun kept ())\n (defun lost ())"), ("b.lisp", "(used)"), ("c.lisp", "broken"), ("d.lisp", None), ("e.ts", "export function f() {}"), ("g.py", "def lost2(): pass")], "p string, c string"), F.col("p"), F.col("c"))
    plugins.remove("lisp")


def test_added_language(spark, lisp):
    got = sorted(tuple(r) for r in symbols.definitions(lisp).select("path", "line", "language", "name", "column", "ignored").collect())
    assert got == [("a.lisp", 1, "lisp", "used", 7, False), ("a.lisp", 3, "lisp", "kept", 7, True), ("a.lisp", 4, "lisp", "lost", 8, False), ("e.ts", 1, "typescript", "f", 16, False), ("g.py", 1, "python", "lost2", 0, False)]
    assert sorted(r.name for r in symbols.dead_symbols(lisp).collect()) == ["f", "lost", "lost2"]
    assert {r.path: r.failure for r in plugins.facts(lisp, symbols.marker("lodegrain"), symbols.RULED).collect()} == {"a.lisp": None, "b.lisp": None, "c.lisp": "ValueError: not balanced", "e.ts": None}
    assert {r.language: r.files for r in symbols.language_stats(lisp, symbols.definitions(lisp), symbols.dead_symbols(lisp)).collect()} == {"lisp": 4, "python": 1, "typescript": 1}


def test_sql_table_function(spark, lisp):
    lisp.where("path <> 'c.lisp'").createOrReplaceTempView("some_files")
    plugins.register_sql(spark, symbols.marker("lodegrain"))
    for partitioning in ("", " PARTITION BY path"):
        rows = spark.sql(f"SELECT path, language, name, line, ignored FROM code_definitions(TABLE(SELECT path, ext, content FROM some_files WHERE ext <> '.py'){partitioning})").collect()
        assert sorted(map(tuple, rows)) == [("a.lisp", "lisp", "kept", 3, True), ("a.lisp", "lisp", "lost", 4, False), ("a.lisp", "lisp", "used", 1, False), ("e.ts", "typescript", "f", 1, False)]


def test_removed_language_is_gone(spark):
    f = as_files(spark.createDataFrame([("a.lisp", "(defun x ())")], "p string, c string"), F.col("p"), F.col("c"))
    assert symbols.definitions(f).count() == 0
