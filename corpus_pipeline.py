"""A training corpus in five stages: toxicity, quality, near-duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. run() writes what a stage returns as Parquet in the shared folder
and reads it again as the next one's documents; what no later stage reads is deleted.

Every stage but the last returns rows of docs unchanged, all their columns included, so columns of any further names are carried along. Null and empty
texts: the quality stage drops them, as it does all texts of fewer than 20 words; the other stages keep them. An empty table stays empty. Rows repeated
whole are judged alike, and the near-duplicates stage keeps one of them. A null doc_id is a value like others. Missing labels leave the fixed lexicon and rules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrain.llm import decontam, minhash, pieces, quality, toxicity
from lodegrain.llm.common import materialise, modest_batches, rows_of, scratch

MODEL = "piece_bpe_32k.model"
#: Bytes of an Arrow batch: an executor and its Python workers live through all stages, so what the largest batch needs is held to the end.
STAGE_BATCH_BYTES = 1 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the lexicon, learned from all labels, calls toxic. Null and empty texts stay."""
    modest_batches(spark, STAGE_BATCH_BYTES)
    return toxicity.keep_clean(docs, toxicity.fit(docs, rows_of(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the fixed rules or the isolation forest reject; null and empty texts go."""
    modest_batches(spark, STAGE_BATCH_BYTES)
    return quality.keep_clean(docs, rows_of(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more, the one with the least id. Texts without words stay, each distinct row once."""
    modest_batches(spark, STAGE_BATCH_BYTES)
    return minhash.keep_one(docs, minhash.Similarity(80))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item. Null and empty texts hold none."""
    return decontam.remove_leaks(docs, rows_of(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each whole text, their number, and the text they decode to; null and empty texts have no ids. Encoding and decoding are one pass, so a task has one Python worker."""
    modest_batches(spark, STAGE_BATCH_BYTES)
    coded = docs.select("doc_id", "lang", "source", pieces.round_trip(F.col("text"), public_tokenizers.path(MODEL)).alias("e"))
    return coded.select("doc_id", "lang", "source", F.size("e.ids").cast("long").alias("n_tokens"), "e.ids", "e.decoded")


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("pieces", to_pieces)]

#: SQL can't express the forest nor the encoder; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a corpus folder."""
    docs = rows_of(spark, sf_dir, "documents")
    with scratch(spark) as write:
        for name, stage in STAGES[:-1]:
            docs = write(stage(spark, docs, sf_dir), name)
        name, stage = STAGES[-1]
        return materialise(stage(spark, docs, sf_dir), name)
