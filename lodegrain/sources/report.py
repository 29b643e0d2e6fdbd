"""One JSON document of any number of rows: tasks write parts, the commit puts the envelope around them.

The folder must be one that the driver and all executors see. A part that no committed task wrote, from a task that failed or ran twice, is not part of the document.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Stands for the rows in an envelope.
ROWS = "__rows__"


@dataclass
class _Part(WriterCommitMessage):
    path: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.head, self.tail = options["envelope"].split(json.dumps(ROWS))
        self.column = options.get("column", "value")

    def write(self, rows: Iterator[Row]) -> _Part:
        folder = f"{self.path}.parts"
        os.makedirs(folder, exist_ok=True)
        path, n = f"{folder}/{uuid.uuid4().hex}", 0
        with open(path, "w", encoding="utf-8") as f:
            for row in rows:
                f.write((",\n" if n else "") + row[self.column])
                n += 1
        return _Part(path, n)

    def commit(self, messages: list[_Part | None]) -> None:
        if os.path.exists(self.path) and not self.overwrite:
            shutil.rmtree(f"{self.path}.parts", ignore_errors=True)
            raise FileExistsError(self.path)
        parts, whole = [m for m in messages if m is not None and m.rows], f"{self.path}.{uuid.uuid4().hex}"
        with open(whole, "wb") as out:
            out.write(self.head.encode() + b"[")
            for i, part in enumerate(parts):
                out.write(b",\n" if i else b"\n")
                with open(part.path, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
            out.write(b"]" + self.tail.encode())
        os.replace(whole, self.path)
        shutil.rmtree(f"{self.path}.parts", ignore_errors=True)

    def abort(self, messages: list[_Part | None]) -> None:
        shutil.rmtree(f"{self.path}.parts", ignore_errors=True)


class Report(DataSource):
    """df.write.format("json_document"). Options: path of the document, envelope (a JSON text in which "__rows__" stands for the list of rows), column of the rows' JSON texts (value)."""

    @classmethod
    def name(cls) -> str:
        return "json_document"

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def write_document(rows: DataFrame, path: str, envelope: object, overwrite: bool = True) -> None:
    """Write rows(value: JSON texts) as the list that ROWS stands for in envelope, once. Null values are left out. Rows keep the order of their partitions."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(Report)
    text = json.dumps(envelope, ensure_ascii=False)
    if text.count(json.dumps(ROWS)) != 1:
        raise ValueError("the envelope must hold the place of the rows once")
    rows.where("value is not null").select("value").write.format("json_document").option("path", path).option("envelope", text).mode("overwrite" if overwrite else "append").save()
