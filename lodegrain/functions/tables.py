"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one in local mode (tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodegrain-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def merged(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """left joined with right by sorting and merging, where either may be large. The planner knows the bytes of what a table is made from, not what texts are cut into,
    and by itself would send such a side through the driver to all executors."""
    return left.join(right.hint("merge"), on, how)


def written(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder, so that it is worked out once."""
    path = f"{shared_folder(df.sparkSession)}/lodegrain-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
