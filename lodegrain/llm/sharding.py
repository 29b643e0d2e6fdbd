"""Longest-processing-time sharding: groups of equal texts, largest first, to the least-loaded shard.

Every group is scheduled by the one rule. The schedule needs no more than how many groups have each size: groups of one size are alike, so the driver holds the distinct sizes
(their sum is at most all bytes, so there are at most the square root of twice as many) and the heap is replaced by its outcome where a size has many groups: a
run of equal items fills the least loads up to one level. The schedule says how many groups of a size each shard gets; Spark numbers the groups of a size, in chunks, and
each takes the shard of its number.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegrain.llm.common import materialise

#: Groups of one size from which their run is placed at once, not by the heap; both give the same.
RUN = 64
#: A text with 1/SHARES of all rows or more is placed by a broadcast.
SHARES = 1000
#: Rows of a shard are numbered in chunks of about this many.
CHUNK_ROWS = 500_000
MIN_CHUNKS = 64


def lpt(sizes: np.ndarray, groups: np.ndarray, shards: int) -> np.ndarray:
    """How many of the groups of each size go to each shard, where so many groups have each of the distinct, positive sizes.

    The largest size first, each group to the shard with the least load, ties by shard number.
    """
    heap, loads, placed = [(0, s) for s in range(shards)], [0] * shards, np.zeros((len(sizes), shards), np.int64)
    for at in np.argsort(-sizes):
        size, left = int(sizes[at]), int(groups[at])
        if left >= RUN:
            got = filled(loads, size, left)
            placed[at] = got
            loads = [x + n * size for x, n in zip(loads, got, strict=True)]
            heap = [(x, s) for s, x in enumerate(loads)]
            heapq.heapify(heap)
            continue
        for _ in range(left):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            loads[s] += size
            placed[at, s] += 1
    return placed


def filled(loads: list[int], size: int, groups: int) -> list[int]:
    """How many of so many equal groups each shard gets, were they placed one by one: a shard gets those that it takes while its load is below a level, and
    the last ones go by load and shard number among those at the level's edge."""
    below = lambda level: [max(0, -(-(level - x) // size)) for x in loads]
    low, high = min(loads), max(loads) + (groups // len(loads) + 2) * size
    while high - low > 1:  # the highest level that takes no more than there are
        middle = (low + high) // 2
        low, high = (middle, high) if sum(below(middle)) <= groups else (low, middle)
    got = below(low)
    rest = groups - sum(got)
    for _, s in sorted((x + n * size, s) for s, (x, n) in enumerate(zip(loads, got, strict=True)))[:rest]:
        got[s] += 1
    return got


def shard_documents(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Adds to each row its size, text_crc32, shard and slot; rows with equal text share a shard.

    Null texts count as empty ones: size 16, CRC 0, one group with the empty texts. Repeated rows are separate
    rows with separate slots. A null doc_id is a value like others. An empty table gives an empty result. Of the
    input's columns only doc_id is returned, so clashing names don't matter.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = materialise(
        docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + 16).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.unhex(F.md5(body.cast("binary"))).alias("_key")),
        "sized",
    )
    spark = docs.sparkSession
    groups = materialise(base.groupBy("_key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("_rows")), "groups")
    counted = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toArrow()
    sizes, alike = (counted[c].to_numpy().astype(np.int64) for c in ("bytes", "n"))
    rows, chunks = groups.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0], max(MIN_CHUNKS, -(-int(alike.sum()) // CHUNK_ROWS))
    ends = np.cumsum(lpt(sizes, alike, shards), axis=1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1, dtype=np.int32) * shards), pa.array(ends.ravel()))
    schedule = spark.createDataFrame(pa.table({"bytes": pa.array(sizes, pa.int64()), "_ends": lists}))
    own = number_rows(groups, "bytes", chunks, ("_key",), ("_key",), schedule).select("_key", "_rows", F.size(F.filter("_ends", lambda x: x <= F.col("slot"))).alias("shard"))
    own = materialise(own, "own")
    # a key with a share of the rows, of which there can be no more than SHARES, is not shuffled
    many = F.broadcast(own.where(F.col("_rows") * SHARES >= F.lit(max(rows, 1))).select("_key", "shard"))
    put = base.join(many, "_key").unionByName(base.join(many, "_key", "left_anti").join(own.select("_key", "shard"), "_key"))
    return number_rows(put, "shard", max(MIN_CHUNKS, -(-rows // (shards * CHUNK_ROWS))), ("doc_id", "_key"), ("doc_id", "size", "text_crc32", "_key")).select("doc_id", "size", "text_crc32", "shard", "slot")


def number_rows(df: DataFrame, of: str, chunks: int, deal: tuple[str, ...], order: tuple[str, ...], beside: DataFrame | None = None) -> DataFrame:
    """slot: 0, 1, 2 and so on within each value of a column. Its rows are dealt over chunks by the columns deal; chunks are numbered in parallel and shifted by the rows before them.
    beside has a row for each value, with columns that its rows get by their chunks."""
    df = df.withColumn("_chunk", F.pmod(F.xxhash64(*deal), F.lit(chunks)).cast("int"))
    counts = df.groupBy(of, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(of).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(of, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if beside is not None:
        starts = starts.join(beside, of)
    within = Window.partitionBy(of, "_chunk").orderBy(*order)
    numbered = df.withColumn("_rank", F.row_number().over(within) - 1)
    return numbered.join(starts, [of, "_chunk"]).withColumn("slot", (F.col("_start") + F.col("_rank")).cast("long")).drop("_chunk", "_start", "_rank")
