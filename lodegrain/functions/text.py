"""Expressions over source text: lines, ASCII word edges, ordered rules, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edges of ASCII words; Java's own \b is Unicode-aware.
EDGE_L, EDGE_R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
IDENT = r"[A-Za-z_][A-Za-z0-9_]*"
COMMENT_LINE = r"^\s*(?://|#|\*|/\*)"


def free_name(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while base.lower() in taken:
        base += "_"
    return base


def word(pattern: str) -> str:
    """pattern as a whole ASCII word."""
    return f"{EDGE_L}(?:{pattern}){EDGE_R}"


def lines_of(files: DataFrame) -> DataFrame:
    """files(path, ext, content) to (path, ext, line, text); lines count from 1 and an empty last line stays. Null contents have no lines."""
    return files.where("content is not null").select("path", "ext", F.posexplode(F.split("content", "\n")).alias("_at", "text")).select("path", "ext", (F.col("_at") + 1).alias("line"), "text")


def first_rule(text: Column, rules: list[tuple[str, str, int]]) -> Column:
    """struct(kind, name) of the first of the rules (kind, pattern, group) that matches; null if none does."""
    return F.coalesce(*(F.when(text.rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(text, p, g).alias("name"))) for kind, p, g in rules))


def by_extension(ext: Column, cases: dict[tuple[str, ...], Column]) -> Column:
    """The value for the file's extension; null for others."""
    return F.coalesce(*(F.when(ext.isin(list(exts)), value) for exts, value in cases.items()))


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit(""))


def normal_path(path: Column) -> Column:
    """A relative path without . and .. steps."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
