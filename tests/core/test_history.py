"""Common subsequences and line ages against tables written out."""

import random

import pytest
from pyspark.sql import functions as F

from lodegrain.functions import lcs
from lodegrain.operators import findings, history


def length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


@pytest.mark.parametrize("bits", [1 << 25, 40, 1])
def test_common_is_longest(monkeypatch, bits):
    monkeypatch.setattr(lcs, "TABLE_BITS", bits)
    rng = random.Random(bits)
    for _ in range(400):
        a, b = ([rng.choice("abcdxy"[: rng.randint(1, 6)]) for _ in range(rng.randint(0, 24))] for _ in range(2))
        pairs = lcs.common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == length(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_long_files_with_repeated_lines():
    rng = random.Random(9)
    a = [rng.choice(["", "}", "x = 1", str(rng.random())]) for _ in range(30_000)]
    b = [x for x in a if rng.random() > 0.1]
    assert len(lcs.common(a, b)) == len(b)


VERSIONS = "path string, version int, commit string, author string, author_time long, summary string, content string"


def test_ages_equal_a_walk_through_the_versions(spark):
    """A random history: equal to following each line by hand where lines are unique, so that there is one common subsequence."""
    rng, rows, want, n = random.Random(3), [], [], 0
    for f in range(12):
        lines: list[tuple[str, int]] = []
        for v in range(rng.randint(1, 8)):
            lines = [x for x in lines if rng.random() > 0.2]
            for _ in range(rng.randint(0, 6)):
                lines.insert(rng.randint(0, len(lines)), (f"line {n}", v))
                n += 1
            rows.append((f"f{f}", v, f"c{v}", f"a{v % 3}", 1000 + v, None, "\n".join(x for x, _ in lines) if lines else None))
        want += [(f"f{f}", i + 1, f"c{v}", f"a{v % 3}", 1000 + v) for i, (_, v) in enumerate(lines)]
    rng.shuffle(rows)
    got = history.line_ages(spark.createDataFrame(rows, VERSIONS).repartition(5))
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(want)


def test_odd_versions(spark):
    """No commit or summary column, an empty text, a text taken back, null times, clashing columns, an empty table."""
    v = spark.createDataFrame([("a", 1, "x", 10, "p\nq", 1), ("a", 2, "y", 20, None, 1), ("a", 3, "z", None, "p\nr", 1), ("b", 1, "x", 5, "", 1), ("c", 1, "x", 5, None, 1)], "path string, version int, author string, author_time long, content string, line int")
    assert sorted(tuple(r) for r in history.line_ages(v).collect()) == [("a", 1, None, "z", None, None), ("a", 2, None, "z", None, None), ("b", 1, None, "x", 5, None)]
    assert history.line_ages(v.where("false")).count() == 0
    assert sorted(tuple(r) for r in history.nth_last_change(v, 2).collect()) == [("a", 20)]


def test_ages_serve_the_detectors(spark):
    v = spark.createDataFrame([("t.py", 1, "c", "ann", 0, "s", "x = 1"), ("t.py", 2, "d", "bob", 86400 * 5, "s", "x = 1\n# TODO: y")], VERSIONS)
    ages = history.line_ages(v)
    dead = spark.createDataFrame([("t.py", 1), ("t.py", 2), ("u.py", 1)], "path string, line int")
    kept = history.dead_since(dead, ages, 7, F.lit(86400 * 10))
    assert sorted(tuple(r) for r in kept.collect()) == [("t.py", 1, 10), ("u.py", 1, None)]
    files = spark.createDataFrame([("t.py", ".py", "x = 1\n# TODO: y")], "path string, ext string, content string")
    todo = findings.with_age(findings.todos(files), ages.withColumn("days_ago", history.days_ago(F.col("author_time"), F.lit(86400 * 10)))).first()
    assert (todo.author, todo.days_ago) == ("bob", 5)
