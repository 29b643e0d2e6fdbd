"""Age of lines from the versions of files, what is new since a baseline, and what a clean-up would change."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegrain.functions.lcs import common
from lodegrain.functions.tables import merged
from lodegrain.functions.text import lines_of
from lodegrain.operators.symbols import TOOL, marker

#: Lines of a result batch.
LINES = 10_000
#: What a line's last change carries along.
CHANGE = ("commit", "author", "author_time", "summary")


class _Ages:
    """The lines of one file's newest version so far, and the version that each stems from."""

    def __init__(self, path: str | None):
        self.path, self.lines, self.origin, self.changes = path, [], np.zeros(0, np.int64), []

    def add(self, content: str | None, change: tuple) -> None:
        lines = [] if content is None else content.split("\n")
        origin = np.full(len(lines), len(self.changes))
        if pairs := common(self.lines, lines):
            old, new = np.array(pairs).T
            origin[new] = self.origin[old]
        self.lines, self.origin = lines, origin
        self.changes.append(change)

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.lines), LINES):
            origin = self.origin[at : at + LINES]
            columns = zip(*(self.changes[i] for i in origin.tolist()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([[self.path] * len(origin), range(at + 1, at + 1 + len(origin)), *columns], schema, strict=True)], schema=schema)


def line_ages(versions: DataFrame) -> DataFrame:
    """(path, line, commit, author, author_time, summary): the change that each line of each file's newest version stems from.

    versions has path, version (their order), author, author_time (epoch seconds) and content, and may have commit and summary, else null. A line stems from the first of
    the successive versions in which it stands, where the lines that two versions share are a longest common subsequence. Each file's versions come to a task in order, which holds two of
    them at a time and goes on to the next file. A null content is a version without lines; an empty one has one empty line; of versions with the same number the later change counts
    as the later. Other columns play no part.
    """
    have = {c.lower() for c in versions.columns}
    change = [F.col(c).cast("bigint" if c == "author_time" else "string").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in CHANGE]
    some = versions.select("path", "version", "content", *change)
    dealt = some.repartition("path").sortWithinPartitions("path", "version", "author_time", "commit", "content")
    schema = pa.schema([("path", pa.string()), ("line", pa.int32()), ("commit", pa.string()), ("author", pa.string()), ("author_time", pa.int64()), ("summary", pa.string())])

    def aged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Ages | None = None
        for batch in batches:
            for path, content, *changed in zip(*(batch.column(c).to_pylist() for c in ("path", "content", *CHANGE)), strict=True):
                if now is None or now.path != path:
                    if now is not None:
                        yield from now.batches(schema)
                    now = _Ages(path)
                now.add(content, tuple(changed))
        if now is not None:
            yield from now.batches(schema)

    return dealt.mapInArrow(aged, "path string, line int, commit string, author string, author_time bigint, summary string")


def nth_last_change(versions: DataFrame, n: int) -> DataFrame:
    """(path, author_time) of each file's n-th change from the last; files with fewer changes have none."""
    order = Window.partitionBy("path").orderBy(F.desc("version"), F.desc("author_time"))
    return versions.select("path", "author_time", F.row_number().over(order).alias("_n")).where(F.col("_n") == n).select("path", "author_time")


def days_ago(author_time: Column, as_of: Column) -> Column:
    """Whole days between two epoch seconds."""
    return F.floor((as_of - author_time) / 86400).cast("int")


def duration_days(text: str) -> int | None:
    """Days of 30d, 2w or 3m; None for anything else, which filters nothing."""
    number, unit = text[:-1], text[-1:]
    return int(number) * {"d": 1, "w": 7, "m": 30}[unit] if number.isdigit() and unit in ("d", "w", "m") else None


def dead_since(rows: DataFrame, blame: DataFrame, days: int | None, as_of: Column) -> DataFrame:
    """rows(path, line, ...) with days_since_last_change from blame(path, line, author_time); those changed within days go, those of unknown age stay. Without days nothing is joined."""
    if days is None:
        return rows.withColumn("days_since_last_change", F.lit(None).cast("int"))
    aged = merged(rows, blame.select("path", "line", days_ago(F.col("author_time"), as_of).alias("days_since_last_change")), ["path", "line"], "left")
    return aged.where(F.coalesce(F.col("days_since_last_change") >= days, F.lit(True)))


def new_since(current: DataFrame, baseline: DataFrame, on: tuple[str, ...] = ("path", "name", "kind")) -> DataFrame:
    """Rows of current whose key the baseline lacks; lines may move. Null keys are equal to each other; repeated rows stay."""
    base = baseline.select(*(F.col(c).alias(f"_{c}") for c in on)).distinct()
    match = F.lit(True)
    for c in on:
        match = match & current[c].eqNullSafe(F.col(f"_{c}"))
    return current.join(base, match, "left_anti")


def save_baseline(rows: DataFrame, path: str) -> None:
    """Write name, kind, path and line of rows as JSON lines to a folder, in place of what it held."""
    rows.select("name", "kind", "path", "line").write.mode("overwrite").json(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """A saved baseline; None if there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema("name string, kind string, path string, line int").json(path)


def edit_plan(dead_rows: DataFrame, action: str = "delete") -> DataFrame:
    """(path, from_line, to_line, action), from the bottom of each file up: what a clean-up would edit. Nothing is written to sources."""
    end = F.coalesce("end_line", "line") if "end_line" in dead_rows.columns else F.col("line")
    return dead_rows.select("path", F.col("line").alias("from_line"), end.alias("to_line"), F.lit(action).alias("action")).orderBy("path", F.desc("from_line"))


def merged_edits(plan: DataFrame) -> DataFrame:
    """(path, from_line, to_line): the lines that deletions of a plan take away, with those that overlap or touch as one."""
    gone = plan.where("action = 'delete' and from_line <= to_line").select("path", "from_line", "to_line")
    before = F.max("to_line").over(Window.partitionBy("path").orderBy("from_line", "to_line").rowsBetween(Window.unboundedPreceding, -1))
    begins = gone.withColumn("_new", F.when(F.col("from_line") > before + 1, 1).when(before.isNull(), 1).otherwise(0))
    run = F.sum("_new").over(Window.partitionBy("path").orderBy("from_line", "to_line").rowsBetween(Window.unboundedPreceding, 0))
    return begins.withColumn("_run", run).groupBy("path", "_run").agg(F.min("from_line").alias("from_line"), F.max("to_line").alias("to_line")).drop("_run")


def apply_edits(files: DataFrame, plan: DataFrame, tool: str = TOOL) -> DataFrame:
    """files(path, ext, content, ...) after a plan(path, from_line, to_line, action) of deletions and ignore marks; size, where there is one, is the new content's.

    Line numbers are those of the contents as they are, so nested and overlapping edits mean what they say. A deletion also takes the tool's mark on the line before it. A mark
    is put before its line with that line's indent, unless the line goes or is marked. Files without edits, and null contents, stay as they are; lines that a file lacks are no error.
    """
    marked = F.col("text").rlike(marker(tool))
    touched = files.join(plan.select("path").distinct(), "path", "left_semi")
    lines = lines_of(touched)
    runs = merged_edits(plan)
    marks = lines.where(marked).select("path", (F.col("line") + 1).alias("from_line")).join(runs.select("path", "from_line"), ["path", "from_line"])
    gone = runs.select("path", F.explode(F.sequence("from_line", "to_line")).alias("line")).union(marks.select("path", F.col("from_line") - 1)).distinct()
    kept = lines.join(gone, ["path", "line"], "left_anti").withColumn("_at", F.lit(1))
    asked = plan.where("action = 'ignore'").select("path", F.col("from_line").alias("line")).distinct()
    above = lines.where(marked).select("path", (F.col("line") + 1).alias("line"))
    sign = F.when(F.col("ext").isin(".py", ".rb"), "# ").otherwise("// ")
    put = kept.join(asked.join(above, ["path", "line"], "left_anti"), ["path", "line"]).withColumn("text", F.concat(F.regexp_extract("text", r"^(\s*)", 1), sign, F.lit(f"{tool}-ignore"))).withColumn("_at", F.lit(0))
    whole = kept.unionByName(put).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "_at", "text"))), lambda x: x["text"]), "\n").alias("_new"))
    edited = touched.join(whole, "path", "left").withColumn("content", F.when(F.col("content").isNotNull(), F.coalesce("_new", F.lit("")))).drop("_new")
    if "size" in files.columns:
        edited = edited.withColumn("size", F.coalesce(F.octet_length("content").cast("bigint"), "size"))
    return files.join(plan.select("path").distinct(), "path", "left_anti").unionByName(edited.select(*files.columns))
