"""Ranked lexical search over document shards of postings with precomputed integer impacts.

build() reads every whole text and writes the index: each row is a shard of some documents in compressed sparse rows, its terms in order of their
64-bit hashes, and for each term the documents that hold it with the integer impact of its occurrences there. search() takes queries in blocks of
bounded bytes; a task adds the weighted impacts of one term after the other to a dense accumulator over the shard's documents, keeps the best k of
each query over its shards, and the best of all tasks are merged by Spark.

Terms are told apart by their hashes: a query's term is taken for another of V terms of the corpus with a probability of V / 2**64.

Null and empty texts, and texts without terms, hold nothing and are never found. A null doc_id is an id like others, behind all others where scores are
equal. Documents repeated whole are documents each. Queries without terms find nothing; equal query texts are worked out once. Empty tables give no rows.
Columns of any further names play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegrain.llm import textkit as K
from lodegrain.llm.common import free_name, materialise

#: Terms of a shard, about; a document with more is a shard of its own.
SHARD_TERMS = 1 << 19
#: Shards of a row group of the index: writers and readers hold whole row groups, and a bound on their bytes is first looked at after a hundred rows.
GROUP_SHARDS = 1
#: Bytes of query texts that are sent to the executors at a time, about.
QUERY_BYTES = 1 << 20
#: Fixed values of the scoring rule: scale and free part of a document's measure, and of an occurrence's impact.
FREE, SLOPE, IMPACT, TERM, MEASURE, WEIGHT = 75, 25, 1_000_000_000, 1000, 12, 1000
SHARD = "doc_ids array<bigint>, terms array<bigint>, starts array<int>, docs array<int>, impacts array<int>"
IS_TERM = np.zeros(256, bool)
IS_TERM[np.r_[48:58, 65:91, 97:123, 128:256]] = True


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends and text number of every run of letters, digits and characters beyond ASCII."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = IS_TERM[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens[inner], closes[inner - 1] = solid[inner], solid[inner - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(offsets, starts, side="right") - 1


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash, with A-Z in lower case, and the text number of every term."""
    data, offsets = K.batch_arrays(texts)
    starts, ends, own = term_spans(data, offsets)
    return K.span_hashes(data, starts, ends, K.LOWER_VALUES) if len(starts) else np.zeros(0, np.uint64), own


def count_terms(text: Column) -> Column:
    """The number of terms of each whole text."""

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        out = []
        for _, part in K.chunked(texts.cast(pa.large_binary()).to_pylist()):
            out.append(np.bincount(term_spans(*K.batch_arrays(part))[2], minlength=len(part)))
        return pa.array(np.concatenate([np.zeros(0, np.int64), *out]), pa.int64())

    return counted(text)


@dataclass(frozen=True)
class Index:
    """shards of postings, and how many documents with terms, and terms with repeats, they were made from."""

    shards: DataFrame
    documents: int
    terms: int


def shard_of(ids: pa.Array, own: np.ndarray, hashes: np.ndarray, documents: int, terms: int) -> pa.RecordBatch:
    """One shard: ids of its documents, and the document and hash of each term, documents ascending."""
    lengths = np.bincount(own, minlength=len(ids)).astype(np.int64)
    measure = FREE + SLOPE * lengths * documents // max(terms, 1)
    order = np.argsort(hashes, kind="stable")  # documents stay in order below each term
    hashes, own = hashes[order], own[order]
    first = np.ones(len(own), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(first)
    tf = np.diff(np.append(at, len(own)))
    hashes, docs = hashes[at], own[at]
    impacts = IMPACT * tf // (TERM * tf + MEASURE * measure[docs])
    opens = np.ones(len(hashes), bool)
    opens[1:] = hashes[1:] != hashes[:-1]
    starts = np.append(np.flatnonzero(opens), len(hashes))
    columns = [ids, hashes[opens].view(np.int64), starts.astype(np.int32), docs.astype(np.int32), impacts.astype(np.int32)]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c)) for c in columns]
    return pa.RecordBatch.from_arrays(lists, ["doc_ids", "terms", "starts", "docs", "impacts"])


def build(docs: DataFrame, write: Callable[..., DataFrame] = materialise) -> Index:
    """Index every row of docs (doc_id, text)."""
    sums = docs.select(count_terms(F.col("text")).alias("n")).agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    documents, terms = sums.documents, sums.terms

    def sharded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        owns: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = n = 0
        for batch in batches:
            for first, texts in K.chunked(batch.column(1).cast(pa.large_binary()).to_pylist()):
                hashes, own = terms_of(texts)
                full = np.unique(own)  # documents without terms are left out
                ids.append(batch.column(0).slice(first, len(texts)).take(pa.array(full)))
                owns.append(n + np.searchsorted(full, own))
                parts.append(hashes)
                n, held = n + len(full), held + len(own)
                if held >= SHARD_TERMS:
                    yield shard_of(pa.concat_arrays(ids), np.concatenate(owns), np.concatenate(parts), documents, terms)
                    ids, owns, parts, held, n = [], [], [], 0, 0
        if held:
            yield shard_of(pa.concat_arrays(ids), np.concatenate(owns), np.concatenate(parts), documents, terms)
        K.give_back()

    shards = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(sharded, SHARD)
    return Index(write(shards, "postings", **{"parquet.block.row.count.limit": GROUP_SHARDS}), documents, terms)


@dataclass(frozen=True)
class Block:
    """Some queries: their distinct terms in order, and for each query the places of its terms there and how often it has them."""

    terms: np.ndarray
    queries: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, texts: list[str]) -> Block:
        hashes, own = terms_of([t.encode() for t in texts])
        terms = np.unique(hashes)
        place = np.searchsorted(terms, hashes)
        return cls(terms, [np.unique(place[own == q], return_counts=True) for q in range(len(texts))])


def found_in(block: Block, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place in a shard of each of a block's terms, and whether it is there."""
    own = terms.view(np.uint64)
    at = np.minimum(np.searchsorted(own, block.terms), len(own) - 1)
    return at, own[at] == block.terms


def best_of(scores: np.ndarray, ids: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores above 0; of equal scores those with the least ids, where last marks ids behind all others. In no order."""
    at = np.flatnonzero(scores > 0)
    if len(at) <= k:
        return at
    values = scores[at]
    bound = values[np.argpartition(values, len(at) - k)[len(at) - k]]
    above, equal = at[values > bound], at[values == bound]
    return np.concatenate([above, equal[np.lexsort((ids[equal], last[equal]))[: k - len(above)]]])


def frequencies(index: Index, block: Block) -> np.ndarray:
    """In how many documents each of a block's terms occurs."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.terms), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column("terms"), batch.column("starts"), strict=True):
                at, there = found_in(block, terms.values.to_numpy())
                starts = starts.values.to_numpy()
                total += np.where(there, starts[at + 1] - starts[at], 0)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    out = np.zeros(len(block.terms), np.int64)
    for r in index.shards.select("terms", "starts").mapInArrow(counted, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def ranked(index: Index, block: Block, k: int) -> DataFrame:
    """query (its number in the block), doc_id, score, rank of the k best documents of each query."""
    df = frequencies(index, block).tolist()
    weights = np.array([math.floor(WEIGHT * math.log((2 * index.documents + 2) / (2 * n + 1))) for n in df], np.int64)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [(none, none, none.astype(bool))] * len(block.queries)
        for batch in batches:
            for shard in range(batch.num_rows):
                doc_ids, terms, starts, docs, impacts = (batch.column(c)[shard].values for c in ("doc_ids", "terms", "starts", "docs", "impacts"))
                last = doc_ids.is_null().to_numpy(zero_copy_only=False)
                ids = doc_ids.fill_null(0).to_numpy()
                at, there = found_in(block, terms.to_numpy())
                starts, docs, impacts = starts.to_numpy(), docs.to_numpy(), impacts.to_numpy().astype(np.int64)
                begins, ends = starts[at].tolist(), starts[at + 1].tolist()
                for q, (places, repeats) in enumerate(block.queries):
                    hits = there[places]
                    if not hits.any():
                        continue
                    sums = np.zeros(len(ids), np.int64)
                    for t, weight in zip(places[hits].tolist(), (repeats[hits] * weights[places[hits]]).tolist(), strict=True):
                        sums[docs[begins[t] : ends[t]]] += weight * impacts[begins[t] : ends[t]]
                    top = best_of(sums, ids, last, k)
                    old = best[q]
                    new = np.concatenate([old[0], sums[top]]), np.concatenate([old[1], ids[top]]), np.concatenate([old[2], last[top]])
                    keep = best_of(*new, k)
                    best[q] = new[0][keep], new[1][keep], new[2][keep]
        sizes = [len(b[0]) for b in best]
        columns = [np.concatenate([none, *(b[c] for b in best)]) for c in (0, 1)]
        null = np.concatenate([none.astype(bool), *(b[2] for b in best)])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), sizes), pa.int32()), pa.array(columns[1].astype(np.int64), pa.int64(), mask=null), pa.array(columns[0].astype(np.int64), pa.int64())], ["query", "doc_id", "score"])
        K.give_back()

    rows = index.shards.mapInArrow(scored, "query int, doc_id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int, write: Callable[..., DataFrame] = materialise) -> DataFrame:
    """Rows of queries (text and any other columns but doc_id, score and rank) with doc_id, score and rank of their k best documents."""
    spark = queries.sparkSession
    block_name = free_name("_block", queries)
    texts = queries.where("text is not null").select("text").distinct()
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, math.ceil(size / QUERY_BYTES))
    dealt = write(texts.withColumn(block_name, F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int")), "queries")
    found = []
    for b in range(blocks):
        own = [r.text for r in dealt.where(F.col(block_name) == b).select("text").collect()]  # about QUERY_BYTES
        block = Block.of(own)
        if not len(block.terms):
            continue
        names = spark.createDataFrame(list(enumerate(own)), "query int, text string")
        found.append(write(ranked(index, block, k).join(F.broadcast(names), "query").drop("query"), "ranked"))
    if not found:
        return queries.limit(0).select("*", F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return queries.join(every, "text")
