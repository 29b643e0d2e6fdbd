"""The numbered queries over the corpus tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrain.llm import bpe, decontam, licences, maincontent, maxent, minhash, negatives, pieces, quality, search, sharding, toxicity, warc
from lodegrain.llm.common import fold_of, fresh_path, materialise, rows_of, scratch
from lodegrain.llm.oracles import ORACLES  # noqa: F401  the entry takes both from here

SHARDS = 40
MODEL = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, as it is or with new parameters."""
    found = decontam.leaks(rows_of(spark, sf_dir, "documents"), rows_of(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "n_windows", "n_slots", "n_changed")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a licence notice or text."""
    return licences.scan(rows_of(spark, sf_dir, "documents")).select("doc_id", "licence", "dice", "units")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out fold."""
    docs, labels = rows_of(spark, sf_dir, "documents"), rows_of(spark, sf_dir, "labels")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    lexicon = toxicity.fit(docs, labels.where(~held_out))
    out = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(F.col("text"), lexicon).alias("r"))
    return out.select("doc_id", "held_out", "r.score", (F.col("r.score") >= 0.5).cast("int").alias("predicted"), "r.n_hits")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under the public BPE model, their byte spans, and the text that they decode to, as digests."""
    path = public_tokenizers.path(MODEL)
    coded = rows_of(spark, sf_dir, "documents").select("doc_id", pieces.round_trip(F.col("text"), path).alias("e")).select("doc_id", "e.*")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.xxhash64("begins", "ends").alias("spans_xxhash64"),
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups at similarity 0.85 of five-word shingle sets."""
    return minhash.near_duplicates(rows_of(spark, sf_dir, "documents"), minhash.Similarity(85))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document, learned from those outside the held-out fold."""
    docs = rows_of(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 7) == 2
    model, cold = maxent.fit(docs.where(~held_out))
    out = maxent.score(docs, model, cold)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts, the forest's score and the verdict for every document."""
    return quality.judge(rows_of(spark, sf_dir, "documents"), rows_of(spark, sf_dir, "labels"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by a classifier fitted to those that mark their article."""
    pages = rows_of(spark, sf_dir, "pages")
    out = pages.select("page_id", "url", maincontent.main_text(F.col("html"), maincontent.fit(pages)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards by longest processing time; equal texts together."""
    out = sharding.shard_documents(rows_of(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page in a deduplicated archive, as read back from it."""
    pages = rows_of(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("payload"))
    path = fresh_path(spark, "archives")
    warc.write_archives(warc.resolve_revisits(pages), path)
    return warc.read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "fault")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    items = rows_of(spark, sf_dir, "benchmark").select("item_id", "text")
    with scratch(spark) as write:
        index = search.build(rows_of(spark, sf_dir, "documents"), write)
        return materialise(search.search(index, items, 20, write).select("item_id", "rank", "doc_id", "score"), "ranked")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every hundredth vector and its positives; every seventh vector's label is moved on by one."""
    label = F.col("label").cast("long")
    rows = rows_of(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), negatives.scaled(F.col("embedding")).alias("vector")
    )
    with scratch(spark) as write:
        index = negatives.build(rows.where("vec_id is not null and label is not null and vector is not null"), write)
        return materialise(negatives.mine(index, negatives.Mining(), write), "negatives")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under the public byte-level BPE vocabulary and the text that they decode to, as digests."""
    coded = rows_of(spark, sf_dir, "documents").select("doc_id", bpe.round_trip(F.col("text"), public_tokenizers.path(BYTE_BPE)).alias("e"))
    return coded.select("doc_id", (F.octet_length("e.packed") / 4).cast("long").alias("n_tokens"), F.sha2("e.packed", 256).alias("ids_sha256"), F.sha2(F.col("e.decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_licences": op2_licences,
    "op3_toxicity": op3_toxicity,
    "op4_pieces": op4_pieces,
    "op5_minhash": op5_minhash,
    "op6_language_model": op6_language_model,
    "op7_quality": op7_quality,
    "op8_main_text": op8_main_text,
    "op9_sharding": op9_sharding,
    "op10_warc": op10_warc,
    "op11_search": op11_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_byte_bpe": op13_byte_bpe,
}
