"""Repeated analysis as sources change: a stream of change events drives it, one analysis for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Changes under these folders are nobody's concern, and the pause in which changes are gathered.
UNWATCHED = r"(?:node_modules|\.git|/dist/|/build/)"
PAUSE = "500 milliseconds"


def watch(events: DataFrame, load: Callable[[list[str] | None], DataFrame], analyse: Callable[[DataFrame], DataFrame], report: Callable[[DataFrame, int], None], checkpoint: str, pause: str = PAUSE) -> StreamingQuery:
    """Start a query over the stream events(path, ...): each pause with a change that counts runs analyse(load(None)) and hands the result to report with the batch's number.

    A batch may run again after a failure, so report should overwrite by number.
    """

    def once(batch: DataFrame, number: int) -> None:
        if not batch.where(~F.col("path").rlike(UNWATCHED)).isEmpty():
            report(analyse(load(None)), number)

    return events.select("path").writeStream.foreachBatch(once).trigger(processingTime=pause).option("checkpointLocation", checkpoint).start()


def bursts(events: DataFrame, ts: str, gap: str = "500 milliseconds", late: str = "10 minutes", *keys: str) -> DataFrame:
    """Runs of events with no pause longer than gap, by keys: (keys, start, end, n). Works on streams, where events later than late are dropped, and on tables."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
