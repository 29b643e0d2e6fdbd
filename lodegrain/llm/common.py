"""Shared helpers: the cluster's shared folder, tables that cut lineage, joins that hot keys can't stop, modest Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that is broadcast, at most (16 to 100 bytes each); larger sides are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Tasks over which the rows of one key are dealt where a small side is too large to broadcast.
SALTS = 32
#: Rows and bytes of an Arrow batch at most (one longer row is a batch). Texts have kilobytes, so that the usual ten thousand rows would fill Python workers.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where that is unset, a temporary folder in local mode (tests), else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lodegrain-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/lodegrain-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str, path: str | None = None, **options: object) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut and lost executors cost no recomputation. The table stays, as results read it later. options are the writer's."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark's executors can write to."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """A function like materialise() whose tables are deleted at the end of the block, so no result may read them after it."""
    folder, n = fresh_path(spark, "scratch"), 0

    def write(df: DataFrame, name: str, **options: object) -> DataFrame:
        nonlocal n
        n += 1
        return materialise(df, name, f"{folder}/{n}-{name}", **options)

    try:
        yield write
    finally:
        delete_folder(spark, folder.rpartition("/")[0])


def free_name(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while base.lower() in taken:
        base += "_"
    return base


def meet(big: DataFrame, small: DataFrame, key: str, deal: str, how: str = "inner") -> DataFrame:
    """big joined with small, a written table with few rows for each key. A counted small side is broadcast, so big stays where it is; else
    the rows of one key of big are dealt over SALTS tasks by their column deal, and small is repeated for each."""
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    salt = free_name("_salt", big, small)
    dealt = big.withColumn(salt, F.pmod(F.xxhash64(deal), F.lit(SALTS)))
    return dealt.join(small.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [key, salt], how).drop(salt)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id written as decimal text, modulo folds; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fold_of_py(doc_id: int | None, folds: int) -> int:
    """fold_of for one Python value."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def modest_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let Python workers get batches of BATCH_ROWS rows and at most so many bytes, unless the session asks for less. Settings of the session: results are worked out after the call, so they stay."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(rows, "10000")) > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if int(spark.conf.get(size, "67108864b").rstrip("b")) > most:
        spark.conf.set(size, str(most))


def rows_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the corpus folder, to be worked on in modest batches."""
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
