"""Hard-negative mining by product quantisation with residual norms.

Every vector is stored as one code for each run of SUB_DIM components, with the norm of what the codes leave over. For an anchor a and a vector x with
centre q and residual r, the score <a, x> lies within |a| |r| of <a, q>, which is a sum of table entries. Centres are integers, so that sum is exact;
the bounds are rounded outwards. A task keeps the best k exact scores of each window and passes a vector on to the exact integer product only if its upper
bound reaches the window and the k-th score known so far: the k-th best of its own, or the k-th lower bound of vectors that are surely in the
window. Nothing that belongs to a result is lost, so recall is 1.

A window is an anchor, the labels it looks at (its own or all others) and a range of scores. Anchors are a stated part of the rows (one of
`every`); they are sent to the executors in blocks of bounded size, each block's windows against all rows.

Rows with a null id, label or vector or with a null or non-finite component take no part. Vectors of unequal lengths count as filled up by zeros; an
empty one scores 0. Components, once scaled, must lie below 2**24 and vectors have at most 2**14 of them, so that scores fit 64 bits; else an error is
raised. Rows of one id are rows each, but none is a positive of an anchor of that id; anchors repeated whole are one. Equal scores go by the smaller id.
Empty tables give no rows. Columns of any further names play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegrain.llm import textkit as K
from lodegrain.llm.common import free_name, materialise

#: Components that share a code, centres of each such run, rounds of fitting them.
SUB_DIM, CENTRES, ROUNDS = 4, 256, 8
#: Rows that centres are fitted to, those with the least hashes of their ids. All rows are indexed.
FIT_ROWS = 4096
#: Anchors that are sent to the executors at a time, about, and those that a task works on at once.
BLOCK_ANCHORS, STEP_ANCHORS = 4096, 64
#: Rows that a task works on at once, and pairs whose exact products it works out at once.
STEP_ROWS, STEP_PAIRS = 4096, 1 << 15
LOWEST, HIGHEST = -(2**62), 2**62
INDEXED = "vec_id bigint, label bigint, codes binary, residual double, vector array<int>"


def scaled(vector: Column, by: int = 256) -> Column:
    """floor(by * component), null where a component or the vector is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(by) * x.cast("double"))))


@dataclass(frozen=True)
class Codebook:
    """Integer centres of each run of components: runs x CENTRES x SUB_DIM."""

    centres: np.ndarray

    @property
    def size(self) -> int:
        return self.centres.shape[0] * SUB_DIM

    @classmethod
    def fit(cls, sample: np.ndarray) -> Codebook:
        """Rounds of nearest centres and means, begun from rows spread over the sample's order by their first component."""
        rows, size = sample.shape
        runs = -(-max(size, 1) // SUB_DIM)
        points = np.zeros((max(rows, 1), runs * SUB_DIM))
        points[:rows, :size] = sample
        centres = np.zeros((runs, CENTRES, SUB_DIM))
        for m in range(runs):
            own = points[:, m * SUB_DIM : (m + 1) * SUB_DIM]
            begin = own[np.lexsort(own.T[::-1])]
            c = begin[np.linspace(0, len(begin) - 1, CENTRES).astype(int)]
            for _ in range(ROUNDS):
                near = nearest(own, c)
                n = np.bincount(near, minlength=CENTRES)
                sums = np.stack([np.bincount(near, own[:, j], CENTRES) for j in range(SUB_DIM)], 1)
                c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
            centres[m] = np.rint(c)
        return cls(centres.astype(np.int64))

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each vector and the norm of its residual, rounded up."""
        codes = np.empty((len(vectors), len(self.centres)), np.uint8)
        left = np.zeros(len(vectors))
        for m, centres in enumerate(self.centres):
            own = vectors[:, m * SUB_DIM : (m + 1) * SUB_DIM]
            codes[:, m] = nearest(own.astype(float), centres.astype(float))
            left += ((own - centres[codes[:, m]]).astype(float) ** 2).sum(1)
        return codes, np.nextafter(np.sqrt(left) * (1 + 1e-9), np.inf)

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """The product of each anchor's run with each centre: runs x anchors x CENTRES."""
        return np.einsum("amd,mcd->mac", anchors.reshape(len(anchors), -1, SUB_DIM), self.centres)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point, some points at a time."""
    square = (centres**2).sum(1)
    parts = [(square - 2 * (points[i : i + 4096] @ centres.T)).argmin(1) for i in range(0, len(points), 4096)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def matrix(lists: pa.Array, size: int) -> np.ndarray:
    """Lists of integers as rows filled up by zeros."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), size), np.int64)
    out[np.arange(size) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


@dataclass(frozen=True)
class Windows:
    """What is looked for: anchors (ids, labels, vectors) and for each window its anchor's number and range of scores, ordered by anchor."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray


@dataclass(frozen=True)
class Index:
    """All rows with codes, residual norms and vectors."""

    rows: DataFrame
    book: Codebook


def build(rows: DataFrame, write: Callable[..., DataFrame] = materialise) -> Index:
    """Index every row of rows (vec_id, label, vector of integers)."""
    spark = rows.sparkSession
    spans = rows.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("n"), F.coalesce(F.max(F.array_max(F.transform("vector", F.abs))), F.lit(0)).alias("top")).first()
    if spans.top >= 1 << 24 or spans.n > 1 << 14:
        raise ValueError("vectors of at most 2**14 components below 2**24 are supported")
    key = free_name("_hash", rows)
    sample = rows.withColumn(key, F.xxhash64("vec_id")).orderBy(key, "vec_id").limit(FIT_ROWS).select(F.col("vector").cast("array<int>")).toArrow()
    book = Codebook.fit(matrix(sample.column(0).combine_chunks(), spans.n))

    def indexed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, residual = book.encode(matrix(batch.column(2), book.size))
            packed = [c.tobytes() for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(residual), batch.column(2)], ["vec_id", "label", "codes", "residual", "vector"])

    typed = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<int>"))
    return Index(write(typed.mapInArrow(indexed, INDEXED), "codes"), Codebook(book.centres))


class Search:
    """The best k of each window among the rows that a task has seen."""

    def __init__(self, book: Codebook, windows: Windows, k: int, same: bool):
        self.book, self.w, self.k, self.same = book, windows, k, same
        self.norms = np.sqrt((windows.vectors.astype(float) ** 2).sum(1)) * (1 + 1e-9)
        none = np.zeros(0, np.int64)
        #: window, score, id of the best so far, for each step of anchors.
        self.best = [(none, none, none)] * -(-len(windows.ids) // STEP_ANCHORS)
        self.exact = 0

    def add(self, ids: np.ndarray, labels: np.ndarray, codes: np.ndarray, residual: np.ndarray, vectors: np.ndarray) -> None:
        """Look through some rows."""
        for step in range(len(self.best)):
            first = step * STEP_ANCHORS
            a = slice(first, first + STEP_ANCHORS)
            own = slice(*np.searchsorted(self.w.anchor, [first, first + STEP_ANCHORS]))
            if own.start == own.stop:
                continue
            tables = self.book.tables(self.w.vectors[a])
            about = np.zeros((len(self.w.ids[a]), len(ids)), np.int64)
            for m in range(codes.shape[1]):
                about += tables[m][:, codes[:, m]]
            slack = np.ceil(self.norms[a][:, None] * residual).astype(np.int64) + 1
            looked = self.w.labels[a][:, None] == labels
            looked = looked & (self.w.ids[a][:, None] != ids) if self.same else ~looked
            self._narrow(step, self.w.anchor[own] - first, own, about - slack, about + slack, looked, ids, vectors)

    def _narrow(self, step: int, anchor: np.ndarray, own: slice, lower: np.ndarray, upper: np.ndarray, looked: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Put the rows that bounds can't rule out to the exact product, one window's bounds from its anchor's."""
        k, low, high = self.k, self.w.low[own], self.w.high[own]
        held_w, held_s, held_i = self.best[step]
        known = np.full(len(anchor), LOWEST)
        full = np.bincount(held_w, minlength=len(anchor)) >= k
        if full.any():
            worst = np.full(len(anchor), HIGHEST)
            np.minimum.at(worst, held_w, held_s)
            known[full] = worst[full]
        at_w, at_row = [], []
        for w in range(len(anchor)):
            below, above, fits = lower[anchor[w]], upper[anchor[w]], looked[anchor[w]]
            sure = below[fits & (below >= low[w]) & (above <= high[w])]
            if len(sure) >= k:
                known[w] = max(known[w], np.partition(sure, len(sure) - k)[len(sure) - k])
            rows = np.flatnonzero(fits & (below <= high[w]) & (above >= max(low[w], known[w])))
            at_w.append(np.full(len(rows), w))
            at_row.append(rows)
        at_w, at_row = np.concatenate(at_w), np.concatenate(at_row)
        self.exact += len(at_w)
        mine = self.w.vectors[self.w.anchor[own]]
        score = np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", mine[at_w[i : i + STEP_PAIRS]], vectors[at_row[i : i + STEP_PAIRS]]) for i in range(0, len(at_w), STEP_PAIRS))])
        good = (score >= np.maximum(low, known)[at_w]) & (score <= high[at_w])
        w, s, i = (np.concatenate(x) for x in ((held_w, at_w[good]), (held_s, score[good]), (held_i, ids[at_row[good]])))
        order = np.lexsort((i, -s, w))
        w, s, i = w[order], s[order], i[order]
        begin = np.concatenate([[0], np.cumsum(np.bincount(w, minlength=len(anchor)))])
        keep = np.arange(len(w)) - begin[w] < k
        self.best[step] = w[keep], s[keep], i[keep]

    def result(self) -> pa.RecordBatch:
        """window, vec_id and score of the best of all windows."""
        first = np.searchsorted(self.w.anchor, np.arange(len(self.best)) * STEP_ANCHORS)
        columns = zip(*((w + f, i, s) for f, (w, s, i) in zip(first.tolist(), self.best, strict=True)), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], ["window", "vec_id", "score"])


def best(index: Index, windows: Windows, k: int, same: bool) -> DataFrame:
    """window, vec_id, score and rank of the best k rows of each window, of the anchor's label or of all others."""
    book = index.book

    def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, held, n = Search(book, windows, k, same), [], 0

        def look() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
            vectors = matrix(t["vector"].combine_chunks(), book.size)
            for i in range(0, t.num_rows, STEP_ROWS):
                r = slice(i, i + STEP_ROWS)
                search.add(t["vec_id"].to_numpy()[r], t["label"].to_numpy()[r], codes[r], t["residual"].to_numpy()[r], vectors[r])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= STEP_ROWS:
                look()
                held, n = [], 0
        if n:
            look()
        yield search.result()
        K.give_back()

    rows = index.rows.select("vec_id", "label", "codes", "residual", "vector").mapInArrow(searched, "window bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("window").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Mining:
    """Anchors are rows whose id is divisible by every; positives of each, negatives of each positive, percent of the positive's score that a negative's lies within."""

    every: int = 100
    positives: int = 5
    negatives: int = 10
    least: int = 30
    most: int = 90


def mine(index: Index, rule: Mining = Mining(), write: Callable[..., DataFrame] = materialise) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor's positives and their negatives."""
    spark = index.rows.sparkSession
    anchors = index.rows.where(F.col("vec_id") % rule.every == 0).select("vec_id", "label", "vector").distinct()
    blocks = max(1, math.ceil(anchors.count() / BLOCK_ANCHORS))
    dealt = write(anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "anchors")
    out = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    for b in range(blocks):
        own = dealt.where(F.col("block") == b).drop("block").toArrow()  # about BLOCK_ANCHORS rows
        found = _mine_block(spark, index, own, rule)
        if found is not None:
            out = out.unionByName(write(found, "negatives"))
    return out


def _mine_block(spark: SparkSession, index: Index, anchors: pa.Table, rule: Mining) -> DataFrame | None:
    n = anchors.num_rows
    if not n:
        return None
    ids, labels, vectors = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), matrix(anchors["vector"].combine_chunks(), index.book.size)
    whole = Windows(ids, labels, vectors, np.arange(n), np.full(n, LOWEST), np.full(n, HIGHEST))
    positives = best(index, whole, rule.positives, same=True).orderBy("window", "rank").toArrow()  # rule.positives for each anchor of the block
    anchor, score = positives["window"].to_numpy(), positives["score"].to_numpy()
    low, high = -(-rule.least * score // 100), rule.most * score // 100
    names = pa.table({"window": pa.array(np.arange(len(anchor))), "anchor_id": pa.array(ids[anchor]), "positive_id": positives["vec_id"], "positive_score": positives["score"]})
    found = best(index, Windows(ids, labels, vectors, anchor, low, high), rule.negatives, same=False)
    named = found.join(F.broadcast(spark.createDataFrame(names)), "window")
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
