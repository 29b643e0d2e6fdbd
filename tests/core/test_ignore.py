"""Ignore files on trees and tables; expected paths follow from the rules by hand."""

import os

import pytest
from pyspark.sql import functions as F

from lodegrain.sources.files import _TreeReader, read_tree
from lodegrain.sources.ignore import Matcher, ignored, rules_of

RULES = [
    ("*.log", {"a.log": True, "x/b.log": True, "a.logs": False, "A.LOG": True}),
    ("/top.txt", {"top.txt": True, "x/top.txt": False}),
    ("x/y", {"x/y": True, "x/y/z.py": True, "a/x/y": False}),
    ("gen/", {"gen": False, "gen/a.py": True, "x/gen/a.py": True}),
    ("**/deep/*.py", {"deep/a.py": True, "x/deep/a.py": True, "deep/x/a.py": False}),
    ("a/**/b", {"a/b": True, "a/x/b": True, "a/x/y/b": True, "ab": False}),
    ("abc/**", {"abc/x": True, "abc/x/y": True, "abc": False}),
    ("*.py\n!keep.py", {"a.py": True, "keep.py": False, "x/keep.py": False}),
    ("d/\n!d/keep.py", {"d/keep.py": True}),
    ("d/*\n!d/keep.py", {"d/keep.py": False, "d/other.py": True}),
    ("!a.py\na.py", {"a.py": True}),
    ("file[0-9].py\nfile[!x-z].rb", {"file1.py": True, "filea.py": False, "filex.rb": False, "filea.rb": True}),
    ("\\#a\n\\!b\n# c\n\n   \n", {"#a": True, "!b": True, "# c": False, "c": False}),
    ("sp \nsp2\\ ", {"sp": True, "sp2 ": True, "sp2": False}),
    ("a?c", {"abc": True, "ac": False, "a/c": False}),
    ("foo.*+(x)", {"foo.b+(x)": True, "fooxb+(x)": False}),
    ("*\n!*/\n!*.py", {"a.py": False, "x/b.py": False, "c.rb": True}),
    ("[", {"[": True}),
    ("", {"a": False}),
]


@pytest.mark.parametrize("text,cases", RULES, ids=[r[0][:12] for r in RULES])
def test_rules_on_tables_and_walks(spark, text, cases):
    rules = rules_of(text)
    got = {r.p: r.i for r in spark.createDataFrame([(p,) for p in cases], "p string").select("p", ignored(F.col("p"), rules).alias("i")).collect()}
    assert got == cases
    m = Matcher(rules)
    walk = lambda p: any(m.verdict("/".join(p.split("/")[:k]), True) for k in range(1, p.count("/") + 1)) or bool(m.verdict(p, False))
    assert {p: walk(p) for p in cases} == cases


def test_trees(spark, tmp_path):
    for p in ("a.py", "gen/x.py", "lib/gen/y.py", "lib/keep.log", "lib/drop.log", "lib/sub/z.py", "lib/sub/w.py", "_under.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    (tmp_path / ".gitignore").write_text("/gen/\n*.log\n!keep.log\n")
    (tmp_path / "lib/sub/.gitignore").write_text("z.py\n")
    paths = lambda **o: sorted(r.path for r in read_tree(spark, str(tmp_path), **o).select("path").collect())
    assert paths() == ["_under.py", "a.py", "lib/gen/y.py", "lib/keep.log", "lib/sub/w.py", "lib/sub/z.py"]
    assert paths(ignore="all") == ["_under.py", "a.py", "lib/gen/y.py", "lib/keep.log", "lib/sub/w.py"]
    assert paths(ignore="none", partitions=3) == ["_under.py", "a.py", "gen/x.py", "lib/drop.log", "lib/gen/y.py", "lib/keep.log", "lib/sub/w.py", "lib/sub/z.py"]
    assert {r.path: r.content for r in read_tree(spark, str(tmp_path)).collect()}["a.py"] == "a.py"


def test_one_folder_is_many_tasks(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    for i in range(10_000):
        (deep / f"f{i}.py").touch()
    (tmp_path / "one.py").touch()
    parts = _TreeReader({"path": str(tmp_path), "partitions": "16"}).partitions()
    sizes = [sum(e - f for _, f, e in p.slices) for p in parts]
    assert len(parts) == 16 and sum(sizes) == 10_001 and max(sizes) == 626
    df = read_tree(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 16 and df.select("path").distinct().count() == 10_001


def test_empty_and_unreadable_trees(spark, tmp_path):
    assert read_tree(spark, str(tmp_path)).count() == 0
    os.symlink(tmp_path / "gone", tmp_path / "link.py")
    (tmp_path / ".gitignore").mkdir()
    assert [tuple(r) for r in read_tree(spark, str(tmp_path)).select("path", "size").collect()] == [("link.py", None)]
