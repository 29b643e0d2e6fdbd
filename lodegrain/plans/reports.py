"""Counts, orders and formats of the detectors' results. Orders have tie-breaks; a top-k keeps its rows in each task before they meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrain.functions.tables import merged
from lodegrain.operators.symbols import estimated_lines

SEVERITIES, RISKS = ("error", "warning", "info"), ("low", "medium", "high", "critical")


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and n, the most frequent first."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)


def counted_of(rows: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """key and n for each of the names in their order, 0 where there is no row."""
    one = rows.agg(*(F.count_if(F.col(key) == x).alias(x) for x in names))
    return one.select(F.posexplode(F.array(*(F.struct(F.lit(x).alias(key), F.col(x).alias("n")) for x in names))).alias("_at", "_x")).select(f"_x.{key}", "_x.n")


def dead_by_file(dead_rows: DataFrame) -> DataFrame:
    """path, dead and estimated_lines, the file with most dead symbols first."""
    return dead_rows.groupBy("path").agg(F.count(F.lit(1)).alias("dead"), F.sum(estimated_lines(F.col("kind"))).cast("bigint").alias("estimated_lines")).orderBy(F.desc("dead"), "path")


def unused_bytes(unused: DataFrame) -> DataFrame:
    """files and bytes of unused files."""
    return unused.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def todos_in_order(rows: DataFrame) -> DataFrame:
    """Annotations by severity, then age, unknown ages last."""
    age = [F.coalesce("days_ago", F.lit(0)).desc()] if "days_ago" in rows.columns else []
    return rows.orderBy(F.desc("severity"), *age, "path", "line")


def catches_by_severity(rows: DataFrame) -> DataFrame:
    return counted_of(rows, "severity", SEVERITIES)


def functions_by_risk(rows: DataFrame) -> DataFrame:
    return counted_of(rows, "risk", RISKS)


def top_functions(rows: DataFrame, most: int | None = None, risk: str | None = None) -> DataFrame:
    """Functions by complexity; with most the first ones of a risk."""
    some = (rows if risk is None else rows.where(F.col("risk") == risk)).orderBy(F.desc("complexity"), "path", "line")
    return some if most is None else some.limit(most)


def top_authors(rows: DataFrame, most: int = 5) -> DataFrame:
    """author and n of those with most rows."""
    return counted(rows.where("author is not null"), "author").limit(most)


def key_counts(keys: DataFrame, dead: DataFrame) -> DataFrame:
    """live and dead: how many of config_keys() of two characters or more are mentioned, and how many are not."""
    left = merged(keys.where(F.length("key") >= 2).select("key"), dead.select("key", F.lit(1).alias("_dead")), "key", "left")
    return left.agg(F.count_if(F.col("_dead").isNull()).alias("live"), F.count("_dead").alias("dead"))


def keys_in_order(rows: DataFrame) -> DataFrame:
    """Rows by key as readers sort: letters before case."""
    return rows.orderBy(F.collate("key", "UNICODE"), "key")


def human_size(size: Column) -> Column:
    """512B, 1.5KB, 2.0MB."""
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit("B"))).when(size < 1024 * 1024, F.format_string("%.1fKB", size / 1024)).otherwise(F.format_string("%.1fMB", size / (1024 * 1024)))


def age_text(days: Column) -> Column:
    """today, 1d ago, 3mo ago, 2y ago."""
    said = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(days == 0, F.lit("today")).when(days < 30, said(days, "d")).when(days < 365, said(days / 30, "mo")).otherwise(said(days / 365, "y"))
