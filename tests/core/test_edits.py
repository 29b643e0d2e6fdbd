"""Edits and boards against brute force."""

import random

from pyspark.sql import functions as F

from lodegrain.operators import history, symbols
from lodegrain.plans import scan
from lodegrain.sources.files import as_files


def test_edits_equal_a_walk_over_lines(spark):
    rng, contents, plan, want = random.Random(5), {}, [], {}
    for f in range(25):
        ext = rng.choice([".py", ".ts"])
        lines = [rng.choice(["a", "  b", "", "# lodegrain-ignore", "\t// lodegrain-ignore", "c"]) for _ in range(rng.randint(1, 12))]
        own = []
        for _ in range(rng.randint(0, 4)):
            first = rng.randint(1, len(lines) + 1)
            own.append((f"f{f}{ext}", first, rng.randint(first, len(lines) + 2), rng.choice(["delete", "delete", "ignore"])))
        gone = {i for _, a, b, act in own if act == "delete" for i in range(a, b + 1)}
        for _, a, _, act in own:
            if act == "delete" and a - 1 not in gone and a > 1 and a - 2 < len(lines) and "lodegrain-ignore" in lines[a - 2]:
                gone.add(a - 1)
        out = []
        for i, text in enumerate(lines, 1):
            if i in gone:
                continue
            if any(act == "ignore" and a == i for _, a, _, act in own) and not (i > 1 and "lodegrain-ignore" in lines[i - 2]):
                out.append(text[: len(text) - len(text.lstrip())] + ("# " if ext == ".py" else "// ") + "lodegrain-ignore")
            out.append(text)
        contents[f"f{f}{ext}"], want[f"f{f}{ext}"] = "\n".join(lines), "\n".join(out)
        plan += own
    files = as_files(spark.createDataFrame([*contents.items(), ("null.py", None)], "p string, c string"), F.col("p"), F.col("c"))
    edits = spark.createDataFrame([*plan, ("null.py", 1, 1, "delete"), ("gone.py", 1, 1, "delete")], "path string, from_line int, to_line int, action string")
    got = {r.path: (r.content, r.size) for r in history.apply_edits(files, edits).collect()}
    assert got == {p: (t, len(t)) for p, t in want.items()} | {"null.py": (None, None)}


def test_merged_edits(spark):
    plan = spark.createDataFrame([("a", 5, 9, "delete"), ("a", 1, 2, "delete"), ("a", 3, 3, "delete"), ("a", 6, 7, "delete"), ("a", 8, 12, "delete"), ("a", 20, 21, "ignore"), ("b", 1, 1, "delete")], "path string, from_line int, to_line int, action string")
    assert sorted(tuple(r) for r in history.merged_edits(plan).collect()) == [("a", 1, 3), ("a", 5, 12), ("b", 1, 1)]


def test_a_failing_detector_leaves_the_others(spark):
    files = as_files(spark.createDataFrame([("a.py", "# TODO: x\nprint(1)\ndef f():\n    pass")], "p string, c string"), F.col("p"), F.col("c"))
    broken = {"secrets": lambda f: f.select("no_such_column"), "todos": lambda f: f.select(F.raise_error(F.lit("boom")).alias("x")).where("x is not null")}
    rows = {r.detector: r for r in scan.safe_board(files, scan.DETECTORS | broken).collect()}
    assert set(rows) == set(scan.DETECTORS) and all(rows[n].issues is None and rows[n].bar is None and rows[n].failure for n in broken)
    assert [n for n, r in rows.items() if r.issues is None] == [n for n in rows if n in broken] and rows["debug_statements"].issues == 1 and rows["debug_statements"].failure is None
    want = {r.detector: (r.issues, r.bar) for r in scan.board(scan.scan(files)).collect()}
    assert {r.detector: (r.issues, r.bar) for r in scan.safe_board(files).collect()} == want


def test_deleting_dead_symbols_leaves_none(spark):
    text = "export function used() {\n  return 1;\n}\nexport function dead(a) {\n  const inner = () => { return a; };\n  return inner;\n}\n// lodegrain-ignore\nexport class Kept {\n  m() {}\n}"
    files = as_files(spark.createDataFrame([("a.ts", text), ("b.ts", "import { used } from './a';\nused();")], "p string, c string"), F.col("p"), F.col("c"))
    dead = symbols.dead_symbols(files)
    after = history.apply_edits(files, history.edit_plan(dead))
    assert {r.path: r.content for r in after.collect()}["a.ts"] == "export function used() {\n  return 1;\n}\n// lodegrain-ignore\nexport class Kept {\n}"
    assert symbols.dead_symbols(after).count() == 0
