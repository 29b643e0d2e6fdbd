"""A source tree as a table of files.

Spark's own text sources hide names that start with a dot or an underscore, so a Python data source lists the tree and deals its files to tasks in equal
numbers. Very large corpora come as tables; as_files() gives them the same columns.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodegrain.sources.ignore import NAME, Matcher, rules_of

SCHEMA = "path string, ext string, size bigint, mtime double, content string"
#: Directories that no analysis enters.
EXCLUDED = ("node_modules", "dist", "build", ".git", "vendor", "target", "__pycache__", "out")


class _Part(InputPartition):
    """Slices of folders: (folder, first, end) of its wanted files in order."""

    def __init__(self, slices: list[tuple[str, int, int]]):
        self.slices = slices


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.excluded = set(filter(None, options.get("exclude", ",".join(EXCLUDED)).split(",")))
        self.ignore = options.get("ignore", "root")
        self.max_bytes = int(options["maxBytes"]) if "maxBytes" in options else None
        self.parts = max(1, int(options.get("partitions", 16)))

    def _wanted(self, name: str) -> bool:
        return name not in self.excluded and (self.hidden or not name.startswith("."))

    def _matchers(self, folder: str, above: list[tuple[str, Matcher]]) -> list[tuple[str, Matcher]]:
        """The ignore files that count in a folder, with the folders they stand in."""
        if self.ignore == "none" or self.ignore == "root" and folder:
            return above
        try:
            with open(os.path.join(self.root, folder, NAME), encoding="utf-8", errors="replace") as f:
                return [*above, (folder, Matcher(rules_of(f.read())))]
        except OSError:
            return above

    @staticmethod
    def _ignored(path: str, folder: bool, matchers: list[tuple[str, Matcher]]) -> bool:
        for base, matcher in reversed(matchers):  # the nearest ignore file that says something decides
            said = matcher.verdict(path[len(base) + 1 :] if base else path, folder)
            if said is not None:
                return said
        return False

    def _files(self, folder: str, matchers: list[tuple[str, Matcher]]) -> tuple[list[str], list[str]]:
        """Paths of the wanted files and folders in a folder, in order; none of a folder that can't be read."""
        files, folders = [], []
        try:
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for e in entries:
                    path = f"{folder}/{e.name}" if folder else e.name
                    is_folder = e.is_dir(follow_symlinks=False)
                    if self._wanted(e.name) and not self._ignored(path, is_folder, matchers) and (is_folder or not e.is_dir()):
                        (folders if is_folder else files).append(path)
        except OSError:
            pass
        return sorted(files), sorted(folders)

    def partitions(self) -> list[InputPartition]:
        """Counts the leaves of each folder and cuts their order into equal parts, so one deep folder is many tasks. The plan holds slices of folders, no files."""
        counts, open_ = [], [("", self._matchers("", []))]
        while open_:
            folder, matchers = open_.pop()
            files, folders = self._files(folder, matchers)
            counts.append((folder, len(files)))
            open_ += [(f, self._matchers(f, matchers)) for f in reversed(folders)]
        each = max(1, -(-sum(n for _, n in counts) // self.parts))
        parts: list[list[tuple[str, int, int]]] = [[]]
        room = each
        for folder, n in counts:
            first = 0
            while first < n:
                if not room:
                    parts.append([])
                    room = each
                take = min(room, n - first)
                parts[-1].append((folder, first, first + take))
                first, room = first + take, room - take
        return [_Part(p) for p in parts]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for folder, first, end in partition.slices:
            matchers = self._matchers("", [])
            steps = folder.split("/") if folder else []
            for k in range(1, len(steps) + 1):
                matchers = self._matchers("/".join(steps[:k]), matchers)
            for path in self._files(folder, matchers)[0][first:end]:
                full, ext = os.path.join(self.root, path), os.path.splitext(path)[1].lower()
                try:
                    info = os.stat(full)
                    content = None
                    if self.max_bytes is None or info.st_size <= self.max_bytes:
                        with open(full, encoding="utf-8", errors="replace") as f:
                            content = f.read()
                except OSError:  # seen in the table, as a file without size
                    yield path, ext, None, None, None
                    continue
                yield path, ext, info.st_size, info.st_mtime, content


class SourceTree(DataSource):
    """spark.read.format("source_tree"). Options: path, hidden (dot files too), exclude (names, by comma), ignore (root: the root's ignore file counts, all: those of all folders, none), maxBytes (files are read whole without it; larger ones then
    have their size and null contents, which tells what was skipped), partitions."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """The files under a folder that every executor sees: path (relative), ext (lower case), size, mtime, content."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").options(**{k: str(v) for k, v in options.items()}).load(root)


def as_files(table: DataFrame, path: Column, content: Column) -> DataFrame:
    """A table of texts as files."""
    p = path.cast("string")
    return table.select(p.alias("path"), F.lower(F.regexp_extract(p, r"[^/.](\.[^./]+)\z", 1)).alias("ext"), F.octet_length(content).cast("bigint").alias("size"), F.lit(None).cast("double").alias("mtime"), content.alias("content"))
