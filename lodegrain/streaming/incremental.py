"""Dead symbols kept up to date as files change: only changed files are read, and only what changed about them travels on.

Two keyed states follow each other in one streaming query. By path, the last facts of a file: its definitions and the names it mentions; a changed file is compared with them,
and what differs becomes messages. By name, the number of files that mention it and its definitions; a message changes the number by one, and definitions whose
verdict changes are reported. A name that many files mention is one number, so its state doesn't grow with the corpus; mentions of names are added up in each task before
they are sent by name.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lodegrain.operators import symbols
from lodegrain.streaming.watch import PAUSE, UNWATCHED

DEFINITION = ("line", "language", "name", "kind", "column", "exported", "ignored", "end_line")
FACTS = "path string, number long, name string, definition string"
MESSAGES = "name string, path string, mentions long, definition string, own boolean"
VERDICTS = "path string, name string, line int, language string, kind string, exported boolean, ignored boolean, dead boolean"


def contents(events: DataFrame, root: str) -> DataFrame:
    """(path, ext, number, content) of the files that events(path, number) name below a folder that all executors see; null contents of files that are gone or can't be read. Every other file stays closed."""

    @F.arrow_udf(T.StringType())
    def read(paths: pa.Array) -> pa.Array:
        out = []
        for p in paths.to_pylist():
            try:
                with open(os.path.join(root, p), encoding="utf-8", errors="replace") as f:
                    out.append(f.read())
            except OSError:
                out.append(None)
        return pa.array(out, pa.string())

    some = events.where(F.col("path").isNotNull() & ~F.col("path").rlike(UNWATCHED))
    return some.select("path", F.lower(F.regexp_extract("path", r"[^/.](\.[^./]+)\z", 1)).alias("ext"), F.col("number").cast("long").alias("number"), read("path").alias("content"))


def facts(changes: DataFrame, tool: str = symbols.TOOL) -> DataFrame:
    """Rows of FACTS for each change(path, ext, number, content): one row without name or definition, one for each definition, and one for each name mentioned. Works on streams."""
    numbered = changes.withColumn("path", F.concat(F.col("number").cast("string"), F.lit(":"), "path"))  # carried along by the path
    defs = symbols.definitions(numbered, tool)
    rows = numbered.select("path", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("definition"))
    rows = rows.union(defs.select("path", "name", F.to_json(F.struct(*DEFINITION)).alias("definition"))).union(symbols.mentions(numbered).select("path", "name", F.lit(None).cast("string")))
    at = F.instr("path", ":")
    return rows.select(F.substring("path", at + 1, F.length("path")).alias("path"), F.substring("path", F.lit(1), at - 1).cast("long").alias("number"), "name", "definition")


class FileFacts(StatefulProcessor):
    """By path: compares a file's new facts with those it had and says what differs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("facts", "name string", "mentioned boolean, definition string")
        self.last = handle.getValueState("number", "number long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        newest, names, defs = -1, set(), {}
        for r in rows:
            if r.number < newest:
                continue
            if r.number > newest:  # a file that changed twice counts as it is at last
                newest, names, defs = r.number, set(), {}
            if r.definition is not None:
                old = defs.get(r.name)
                if old is None or json.loads(r.definition)["line"] < json.loads(old)["line"]:  # the first of several counts
                    defs[r.name] = r.definition
            elif r.name is not None:
                names.add(r.name)
        if self.last.exists() and self.last.get()[0] > newest:
            return
        self.last.update((newest,))
        old = {k[0]: (v[0], v[1]) for k, v in self.held.iterator()}
        new = {n: (n in names, defs.get(n)) for n in names | defs.keys()}
        for name in sorted(old.keys() | new.keys()):
            before, now = old.get(name, (False, None)), new.get(name, (False, None))
            if before == now:
                continue
            if name in new:
                self.held.updateValue((name,), now)
            else:
                self.held.removeKey((name,))
            touches = before[1] is not None or now[1] is not None
            yield Row(name=name, path=key[0] if touches else None, mentions=int(now[0]) - int(before[0]), definition=now[1], own=now[0])

    def close(self) -> None:
        pass


def added_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages with those that only change a name's number added up."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        plain = pa.compute.is_null(table["path"])
        sums = table.filter(plain).group_by("name").aggregate([("mentions", "sum")])
        yield from table.filter(pa.compute.invert(plain)).to_batches()
        n = sums.num_rows
        yield pa.RecordBatch.from_arrays([sums["name"].combine_chunks(), pa.nulls(n, pa.string()), sums["mentions_sum"].combine_chunks().cast(pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.bool_())], batch.schema.names)


class NameUses(StatefulProcessor):
    """By name: how many files mention it, and which files define it and mention it too; reports definitions whose verdict or row changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getValueState("files", "n long")
        self.defined = handle.getMapState("defined", "path string", "definition string, own boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        before = self.files.get()[0] if self.files.exists() else 0
        now, touched = before, {}
        for r in rows:
            now += r.mentions
            if r.path is not None:
                touched[r.path] = (r.definition, r.own)
        self.files.update((now,))
        # only between none, one and more files can the number change a verdict
        every = min(before, 2) != min(now, 2)
        paths = {k[0] for k in self.defined.keys()} | touched.keys() if every else touched.keys()
        for path in sorted(paths):
            old = self.defined.getValue((path,)) if self.defined.containsKey((path,)) else None
            new = touched.get(path, tuple(old) if old else None)
            was = None if old is None else (old[0], before == int(old[1]))
            if new is None or new[0] is None:
                if old is not None:
                    self.defined.removeKey((path,))
                    yield self._row(path, old[0], None)
                continue
            if path in touched:
                self.defined.updateValue((path,), new)
            dead = now == int(new[1])
            if was != (new[0], dead):
                yield self._row(path, new[0], dead)

    @staticmethod
    def _row(path: str, definition: str, dead: bool | None) -> Row:
        d = json.loads(definition)
        return Row(path=path, name=d["name"], line=d["line"], language=d["language"], kind=d["kind"], exported=d["exported"], ignored=d["ignored"], dead=dead)

    def close(self) -> None:
        pass


def verdicts(changes: DataFrame, tool: str = symbols.TOOL) -> DataFrame:
    """Changes of verdicts as a stream: rows of VERDICTS, where dead is true, false, or null for a definition that is gone. The last row of each path and name holds."""
    files = facts(changes, tool).groupBy("path").transformWithState(FileFacts(), MESSAGES, "Append", "None")
    return files.mapInArrow(added_up, MESSAGES).groupBy("name").transformWithState(NameUses(), VERDICTS, "Append", "None")


def watch_dead(events: DataFrame, root: str, report: Callable[[DataFrame, int], None], checkpoint: str, pause: str = PAUSE) -> StreamingQuery:
    """Start a query over the stream events(path, number), where higher numbers are later: report gets the changed verdicts, with dead false for what may not be called dead, and the batch's number.

    The session's state store must be the RocksDB one. A batch may run again after a failure, so report should overwrite by number.
    """
    rows = verdicts(contents(events, root)).withColumn("dead", F.col("dead") & F.when(F.col("dead").isNotNull(), symbols.judged()))
    return rows.writeStream.foreachBatch(report).outputMode("append").trigger(processingTime=pause).option("checkpointLocation", checkpoint).start()
