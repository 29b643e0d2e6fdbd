"""Languages that are read by a Python function: the TypeScript family, and those that users add.

A plugin's function takes a file's text and ending and says what it defines and names; it runs inside tasks, in one Arrow stage for all plugins. What they find is part of
symbols.definitions() and mentions(), and of the SQL table function code_definitions(TABLE(files)).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lodegrain.operators import typescript

#: name, kind, line, column, end line (or None), exported, and the row (from 0) where the statement begins.
Defined = tuple[str, str, int, int, int | None, bool, int]


@dataclass(frozen=True)
class Plugin:
    """A language, the endings of its files in lower case, and read(text, ending) to (definitions, names mentioned elsewhere than where they are defined)."""

    language: str
    extensions: tuple[str, ...]
    read: Callable[[str, str], tuple[list[Defined], list[str]]]


TYPESCRIPT = Plugin("typescript", typescript.EXTS, typescript.read)
_added: dict[str, Plugin] = {}
COLUMNS = "name string, kind string, line int, column int, end_line int, exported boolean, ignored boolean"
FACTS = "struct<definitions:array<struct<name:string,kind:string,line:int,column:int,end_line:int,exported:boolean,ignored:boolean>>,names:array<string>,failure:string>"
_DEFINED = pa.struct([("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("end_line", pa.int32()), ("exported", pa.bool_()), ("ignored", pa.bool_())])
_FACTS = pa.struct([("definitions", pa.list_(_DEFINED)), ("names", pa.list_(pa.string())), ("failure", pa.string())])


def add(plugin: Plugin) -> None:
    """Read a further language. A name that is there is replaced; an ending belongs to the language that had it first."""
    _added[plugin.language] = plugin


def remove(language: str) -> None:
    """Read an added language no more."""
    _added.pop(language, None)


def known() -> list[Plugin]:
    """All plugins, the built-in one first."""
    return [TYPESCRIPT, *_added.values()]


def by_ending(taken: tuple[str, ...] = ()) -> dict[str, Plugin]:
    """The plugin of each ending but those taken."""
    out: dict[str, Plugin] = {}
    for p in known():
        for e in p.extensions:
            if e not in taken:
                out.setdefault(e, p)
    return out


def _facts(plugin: Plugin, text: str, ext: str, marked: re.Pattern) -> tuple[list[tuple], list[str]]:
    """Definitions, ignored if the line before their statement matches, and names of a file."""
    defined, names = plugin.read(text, ext)
    lines = text.split("\n")
    return [(*d, 0 < begin <= len(lines) and bool(marked.search(lines[begin - 1]))) for *d, begin in defined], names


def facts(files: DataFrame, marker: str, taken: tuple[str, ...] = ()) -> DataFrame:
    """(path, language, definitions, names, failure) of the plugins' files: each file is read once, whole. Null contents define and name nothing; neither does a file on which its plugin fails, whose failure is told."""
    plugins, marked = by_ending(taken), re.compile(marker)
    names = [f.name for f in _DEFINED]

    @F.arrow_udf(FACTS)
    def read(contents: pa.Array, exts: pa.Array) -> pa.Array:
        out = []
        for text, ext in zip(contents.to_pylist(), exts.to_pylist(), strict=True):
            try:
                defined, mentioned = _facts(plugins[ext], text, ext, marked)
                out.append({"definitions": [dict(zip(names, d, strict=True)) for d in defined], "names": mentioned, "failure": None})
            except Exception as e:  # noqa: BLE001  a user's function may fail with anything
                out.append({"definitions": [], "names": [], "failure": f"{type(e).__name__}: {e}"})
        return pa.array(out, _FACTS)

    language = F.coalesce(*(F.when(F.col("ext") == e, F.lit(p.language)) for e, p in plugins.items()))
    some = files.where(F.col("ext").isin(list(plugins)) & F.col("content").isNotNull())
    return some.select("path", language.alias("language"), read("content", "ext").alias("_f")).select("path", "language", "_f.definitions", "_f.names", "_f.failure")


def register_sql(spark: SparkSession, marker: str, name: str = "code_definitions") -> None:
    """SELECT * FROM name(TABLE(files) PARTITION BY path): path, language, definition columns for each row of a table with path, ext and content whose ending a plugin known now reads. Any partitioning will do."""
    plugins, pattern = by_ending(), marker

    class Definitions:
        def eval(self, row) -> Iterator[tuple]:
            plugin = plugins.get(row["ext"])
            if plugin is not None and row["content"] is not None:
                for d in _facts(plugin, row["content"], row["ext"], re.compile(pattern))[0]:
                    yield row["path"], plugin.language, *d

    spark.udtf.register(name, udtf(Definitions, returnType=f"path string, language string, {COLUMNS}"))
