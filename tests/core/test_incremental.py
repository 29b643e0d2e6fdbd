"""Verdicts kept by streaming state equal a full analysis after any series of edits."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodegrain.operators import symbols
from lodegrain.sources.files import as_files
from lodegrain.streaming.incremental import watch_dead

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(STORE)


def text_of(rng, ext):
    name = lambda: "n" + rng.choice("abcdefgh")
    lines = []
    for _ in range(rng.randint(0, 5)):
        if ext == ".py":
            lines.append(rng.choice([f"def {name()}():", f"    {name()}({name()})", f"{name()} = {name()}", "# lodegrain-ignore", "__all__ = []"]))
        else:
            lines.append(rng.choice([f"export function {name()}() {{ return {name()}; }}", f"const {name()} = {name()};", f"// {name()}", "// lodegrain-ignore"]))
    return "\n".join(lines)


def test_any_series_of_edits_equals_a_full_run(rocks, tmp_path):
    spark, rng = rocks, random.Random(7)
    root, feed = tmp_path / "root", tmp_path / "feed"
    root.mkdir()
    feed.mkdir()
    now: dict[str, str] = {}
    kept: dict[tuple[str, str], tuple] = {}
    batches: list[int] = []

    def report(rows, number):
        got = rows.collect()
        batches.append(len(got))
        for r in got:
            kept[r.path, r.name] = (r.line, r.kind, r.exported, r.dead)

    events = spark.readStream.schema("path string, number long").json(str(feed))
    query, number = None, 0
    try:
        for step in range(6):
            changed = {f"f{i}{rng.choice(['.py', '.ts'])}" for i in range(8)} if step == 0 else set(rng.sample(sorted(now) + ["new.py", "index.ts", "node_modules/x.py"], 3))
            lines = []
            for p in sorted(changed):
                for _ in range(rng.randint(1, 2)):  # some change twice in a batch
                    number += 1
                    (root / p).parent.mkdir(exist_ok=True)
                    if rng.random() < 0.2 and step:
                        now.pop(p, None)
                        (root / p).unlink(missing_ok=True)
                    else:
                        now[p] = text_of(rng, os.path.splitext(p)[1])
                        (root / p).write_text(now[p])
                    lines.append(f'{{"path": "{p}", "number": {number}}}')
            for p in now:  # what has not changed can't be read, and need not be
                os.utime(root / p, (0, 0))
                if p not in changed:
                    (root / p).write_text("unread = 1")
            (feed / f"{step}.json.tmp").write_text("\n".join(lines))
            os.rename(feed / f"{step}.json.tmp", feed / f"{step}.json")
            if query is None or step == 3:  # ended and begun again from its checkpoint
                if query is not None:
                    query.stop()
                query = watch_dead(events, str(root), report, str(tmp_path / "state"), "0 seconds")
            query.processAllAvailable()
            watched = [(p, t) for p, t in now.items() if "node_modules" not in p]
            files = as_files(spark.createDataFrame(watched, "p string, c string"), F.col("p"), F.col("c"))
            want = {(r.path, r.name): (r.line, r.kind, r.exported, True) for r in symbols.dead_symbols(files).collect()}
            assert {k: v for k, v in kept.items() if v[3]} == want
    finally:
        if query is not None:
            query.stop()
    assert sum(batches) > 20
