"""Near-duplicate groups by SuperMinHash signatures, banding, verification on full shingle sets and distributed union-find.

A document's set is its distinct shingles of five lower-cased words. Documents with equal sets form a class, and only the
class takes part in the search, under a number of its own: a document id may stand beside several texts. SuperMinHash gives every shingle a pseudo-random permutation of the
slots and one fraction per rank; a slot keeps the least rank + fraction, and a document stops at the first rank that can't lower
any slot. A signature is one byte of each slot's value. Bands of it bucket the classes; bands overlap, so that they can be long
(few chance meetings) and many (few missed pairs) at once.

Within a bucket not all pairs are tried. First every class is tried against the most central member of each of its buckets, the one
that meets most others; what passes is contracted to components, and members of one component need no further test. Buckets that then have two
components are settled by what sets their members apart from that central member: A and B differ in |A - P| + |B - P| - 2 * |both| shingles, where X - P is the
symmetric difference of X with the central P, so a pair of near copies that aren't copies of P itself must share about half of those few. They meet at the rarest of
them (prefix and position filter, see Verifier.candidates), not at the many that all copies have. So every pair that shares a bucket is tried, ruled out by exact
bounds or already linked through others, and no bucket is capped. A pair's signatures are compared before its sets; what they rule out is a dozen standard errors away.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrain.llm import textkit as K
from lodegrain.llm.common import BROADCAST_ROWS, free_name, materialise, scratch

Write = Callable[[DataFrame, str], DataFrame]

#: Shingle width, slots of a signature, and bands, each of some slots drawn from a fixed seed. With 12 rows a pair of similarity 0.85
#: shares no band with probability 2e-4, one of 0.4 shares one with 1e-3; with 9 rows the same holds for 0.8.
WIDTH, SLOTS, BANDS = 5, 256, 64
#: Pairs whose signatures agree on a share this far below the threshold are not verified: seven standard errors.
SLACK = 0.16
#: Where more pairs than this are left after the most central members, each class is first tried with the most central of its partners.
MANY_PAIRS = 1_000_000
#: Ranks after which a document's elements get whole permutations instead of lists of swaps.
LISTED_RANKS = 6
#: Text bytes per numpy run.
RUN_BYTES = 1 << 19
SKETCH_TYPE = T.StructType([T.StructField("n", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("signature", T.BinaryType())])
SET_TYPE = T.StructType([T.StructField("k1", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType()))])


def shingles(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and text numbers of each text's distinct shingles. A text with fewer words than WIDTH has one, of all its words."""
    data, offsets = K.batch_arrays(parts)
    starts, ends, own = K.word_spans(data, offsets)
    words = K.span_hashes(data, starts, ends, K.LOWER_VALUES)
    hashes, first = K.windows(words, own, WIDTH)
    texts = own[first]
    count = np.bincount(own, minlength=len(parts))
    bounds = np.concatenate([[0], np.cumsum(count)])
    short = np.flatnonzero((count > 0) & (count < WIDTH))
    if len(short):
        few = [np.uint64(int(count[t])) + K.windows(words[bounds[t] : bounds[t + 1]], own[bounds[t] : bounds[t + 1]], int(count[t]))[0] for t in short]
        hashes, texts = np.concatenate([hashes, *few]), np.concatenate([texts, short])
    keep = distinct(texts, hashes)
    return hashes[keep], texts[keep]


def distinct(own: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indices of one item of each (own, hash)."""
    key = K.mix(hashes ^ (own.astype(np.uint64) + np.uint64(1)) * K.STEP)
    order = np.argsort(key)
    return order[np.concatenate([[True], key[order][1:] != key[order][:-1]])] if len(order) else order


def super_minhash(hashes: np.ndarray, own: np.ndarray, texts: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (texts x slots) of sets of 64-bit elements: the least rank << 32 | fraction of each slot; the largest integer in sets without elements.

    Rank r of an element's permutation swaps places r and k(r). Few ranks are needed as a rule, so a place is looked up in the list of swaps so far.
    """
    signature = np.full(texts * slots, np.iinfo(np.int64).max, np.int64)
    live = np.zeros(texts, bool)
    live[own] = True
    h, o, perm = hashes, own, None
    swaps: list[np.ndarray] = []
    moved: list[np.ndarray] = []
    for rank in range(slots):
        x = K.mix(h + np.uint64((rank + 1) * int(K.STEP) % 2**64))
        k = rank + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - rank) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            slot, first = k, np.full(len(h), rank)
            for old, content in zip(swaps, moved, strict=True):
                slot = np.where(old == k, content, slot)
                first = np.where(old == rank, content, first)
            swaps.append(k)
            moved.append(first)
        else:
            rows = np.arange(len(h))
            slot = perm[rows, k]
            perm[rows, k] = perm[:, rank]
        np.minimum.at(signature, o * slots + slot, (x >> np.uint64(32)).astype(np.int64) | (rank << 32))
        still = live & (signature.reshape(texts, slots).max(1) >= (rank + 1) << 32)
        if not still.any():
            break
        if perm is None or still.sum() < 0.8 * live.sum():
            keep = still[o]
            if not keep.all():
                h, o = h[keep], o[keep]
                swaps, moved = [s[keep] for s in swaps], [m[keep] for m in moved]
                perm = None if perm is None else perm[keep]
            live = still
        if perm is None and rank + 1 == min(LISTED_RANKS, slots):
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(h), 1))
            rows = np.arange(len(h))
            for r, k in enumerate(swaps):
                perm[rows, k] = perm[:, r]
            swaps, moved = [], []
    return signature.reshape(texts, slots)


def short_form(signature: np.ndarray) -> np.ndarray:
    """One byte for each slot's value."""
    return (K.mix(signature.astype(np.uint64) + np.uint64(1)) >> np.uint64(56)).astype(np.uint8)


def band_keys(short: np.ndarray, rows: int, bands: int = BANDS) -> np.ndarray:
    """A hash of every band of signatures in short form, its number included."""
    rng = np.random.default_rng(11)
    picks = np.stack([rng.permutation(short.shape[1])[:rows] for _ in range(bands)])
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(short), bands)).copy()
    for r in range(rows):
        out = K.mix(out * K.STEP + short[:, picks[:, r]])
    return out.astype(np.int64)


@F.arrow_udf(SKETCH_TYPE)
def sketch(texts: pa.Array) -> pa.Array:
    """Set size, a 128-bit key of the set, and its signature (null of an empty set)."""
    size, k1, k2, short = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for _, run in K.chunked(texts.cast(pa.binary()).to_pylist(), RUN_BYTES):
        hashes, own = shingles(run)
        n = np.bincount(own, minlength=len(run))
        sums = np.zeros((2, len(run)), np.uint64)
        np.add.at(sums[0], own, K.mix(hashes))
        np.add.at(sums[1], own, K.mix(hashes ^ K.STEP))
        short += [row.tobytes() if m else None for row, m in zip(short_form(super_minhash(hashes, own, len(run))), n.tolist(), strict=True)]
        size.append(n)
        k1.append(sums[0].astype(np.int64))
        k2.append(sums[1].astype(np.int64))
    K.give_back()
    return pa.StructArray.from_arrays([pa.array(np.concatenate(size).astype(np.int64)), pa.array(np.concatenate(k1)), pa.array(np.concatenate(k2)), pa.array(short, pa.binary())], ["n", "k1", "k2", "signature"])


def bands_of(signature: Column, rows: int) -> Column:
    """The band keys of a signature."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def keys(signatures: pa.Array) -> pa.Array:
        short = np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(-1, SLOTS)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(short) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(short, rows).ravel()))

    return keys(signature)


@F.arrow_udf(T.DoubleType())
def agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    """The share of slots in which two signatures agree."""
    x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint8).reshape(-1, SLOTS) for s in (a, b))
    return pa.array((x == y).mean(1) if len(x) else np.zeros(0))


@F.arrow_udf(SET_TYPE)
def full_set(texts: pa.Array) -> pa.Array:
    """The set's key and its members' hashes."""
    k1, flat, bounds = [], [np.zeros(0, np.uint64)], [0]
    for _, run in K.chunked(texts.cast(pa.binary()).to_pylist(), RUN_BYTES):
        hashes, own = shingles(run)
        order = np.argsort(own, kind="stable")
        sums = np.zeros(len(run), np.uint64)
        np.add.at(sums, own, K.mix(hashes))
        k1 += sums.astype(np.int64).tolist()
        flat.append(hashes[order])
        bounds += (bounds[-1] + np.cumsum(np.bincount(own, minlength=len(run)))).tolist()
    K.give_back()
    return pa.StructArray.from_arrays([pa.array(k1, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(flat).astype(np.int64)))], ["k1", "hashes"])


@F.arrow_udf(T.LongType())
def shared_count(a: pa.Array, b: pa.Array) -> pa.Array:
    """Size of the intersection of two arrays of distinct hashes, row by row."""
    total = np.zeros(len(a), np.int64)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        total[i] = len(np.intersect1d(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False), assume_unique=True))
    K.give_back()
    return pa.array(total)


def components(edges: DataFrame, write: Write = materialise) -> DataFrame:
    """edges(a, b) to (node, comp), comp being the least node reachable: alternating large and small stars till nothing changes."""
    state, seen = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), None
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        state = write(small, "stars")
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()  # the same in any order of rows
        if now == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        seen = now


@dataclass(frozen=True)
class Similarity:
    """Links sets whose intersection is at least percent/100 of their union."""

    percent: int = 80

    @property
    def rows(self) -> int:
        """Slots of a band."""
        return 12 if self.percent >= 85 else 9

    def sizes_allow(self, a: str, b: str):
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def gap(self, apart: Column, n: Column) -> Column:
        """A set's part in what a pair must share: sets linked have (gap + gap) / weight or more in common of what sets them apart from a third."""
        return (100 + self.percent) * apart - (100 - self.percent) * n

    @property
    def weight(self) -> int:
        return 2 * (100 + self.percent)

    def linked(self, shared: str, a: str, b: str):
        return 100 * F.col(shared) >= self.percent * (F.col(a) + F.col(b) - F.col(shared))


class Verifier:
    """Tries pairs of classes on their full sets. Sets are worked out once, when a class is first wanted."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, rule: Similarity, write: Write):
        self.docs, self.nodes, self.rule, self.write = docs.select(row_key(docs).alias("key"), "text"), nodes, rule, write
        self.sets: DataFrame | None = None

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """(rep, hashes) of at least the classes wanted(rep, key, k)."""
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("rep"), "rep", "left_anti")
        wanted = self.write(wanted.distinct(), "wanted")
        n = wanted.count()
        if n:
            # one of the rows that share a key is looked at, and it counts if its set is the class's
            texts = self.docs.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, "key").select("rep", "k", "text", F.xxhash64(F.lit(1), "text").alias("_h")).dropDuplicates(["rep", "_h"])
            found = texts.select("rep", "k", full_set(F.col("text")).alias("s")).where("s.k1 = k")
            more = self.write(found.select("rep", F.col("s.hashes").alias("hashes")), "sets")
            self.sets = more if self.sets is None else self.sets.union(more)
        return self.sets

    def candidates(self, members: DataFrame) -> DataFrame:
        """Pairs (a, b) of members(base, rep, comp, outside) of one base and different components, at least one outside, without those that can't be linked.

        What sets a member apart from the base is ordered by how many outside members have it too, the rarest first. Of a pair that shares as much as its gaps ask for, the
        first shared item is so early in both orders that enough others may follow it; at such items alone do two members meet.
        """
        nodes = self.nodes.select("rep", "key", F.col("k1").alias("k"))
        sets = self.sets_of(nodes.join(members.select("rep").union(members.select("base")).distinct(), "rep"))
        both = members.where("rep <> base").join(sets, "rep").join(sets.select(F.col("rep").alias("base"), F.col("hashes").alias("_of_base")), "base")
        own, away = F.array_except("hashes", "_of_base"), F.array_except("_of_base", "hashes")
        n = F.size("hashes").cast("long")
        gap = self.rule.gap(F.size("apart").cast("long"), F.col("n"))
        apart = self.write(both.select("base", "rep", "comp", "outside", n.alias("n"), F.concat(own, away).alias("apart")).withColumn("gap", gap).drop("n"), "apart")
        # who else has an item: outside members meet all, others only those outside
        item = Window.partitionBy("base", "h")
        items = apart.select("base", "rep", "outside", F.explode("apart").alias("h"))
        counted = items.select("*", F.count_if("outside").over(item).alias("times"), F.count(F.lit(1)).over(item).alias("all"))
        shared = counted.where("times > 0 and all > 1").groupBy("base", "rep").agg(F.array_sort(F.collect_list(F.struct("times", "h"))).alias("items"))
        least = apart.groupBy("base").agg(F.min("gap").alias("any"), F.min(F.when(F.col("outside"), F.col("gap"))).alias("out"))
        first = F.col("gap") + F.when(F.col("outside"), F.col("any")).otherwise(F.col("out"))
        listed = apart.drop("apart").join(shared, ["base", "rep"]).join(least, "base").withColumn("all", F.size("items")).withColumn("need", F.greatest(F.ceil(first / self.rule.weight), F.lit(1)))
        early = listed.where("need <= all").select("base", "rep", "comp", "outside", "gap", "all", F.posexplode(F.slice("items", F.lit(1), (F.col("all") - F.col("need") + 1).cast("int"))).alias("at", "i"))
        early = self.write(early.select("base", "rep", "comp", "outside", "gap", F.col("i.h").alias("h"), (F.col("all") - F.col("at")).alias("left")), "early")
        x, y = early.alias("x"), early.where("outside").alias("y")
        met = (F.col("x.base") == F.col("y.base")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.comp") != F.col("y.comp")) & (~F.col("x.outside") | (F.col("x.rep") < F.col("y.rep")))
        enough = self.rule.weight * F.least("x.left", "y.left") >= F.col("x.gap") + F.col("y.gap")
        return x.join(y, met & enough).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()

    def try_pairs(self, pairs: DataFrame) -> DataFrame | None:
        """pairs(a, b) that are linked; None if no pair is near."""
        of = lambda x: self.nodes.select(F.col("rep").alias(x), F.col("n").alias("n" + x), F.col("k1").alias("k" + x), F.col("key").alias("key" + x), F.col("signature").alias("s" + x))
        known = pairs.join(of("a"), "a").join(of("b"), "b").where(self.rule.sizes_allow("na", "nb"))
        near = self.write(known.where(agreement(F.col("sa"), F.col("sb")) >= self.rule.percent / 100 - SLACK).drop("sa", "sb"), "near")
        if near.isEmpty():
            return None
        sets = self.sets_of(near.select(F.col("a").alias("rep"), F.col("keya").alias("key"), F.col("ka").alias("k")).union(near.select("b", "keyb", "kb")))
        both = near.join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb")), "b").join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha")), "a")
        linked = both.select("a", "b", "na", "nb", shared_count(F.col("ha"), F.col("hb")).alias("shared")).where(self.rule.linked("shared", "na", "nb"))
        return self.write(linked.select("a", "b"), "links")

    def linked(self, labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """labels(rep, comp) after pairs(a, b) have been tried."""
        links = None if pairs.isEmpty() else self.try_pairs(pairs)
        return labels if links is None or links.isEmpty() else _relabelled(labels, links, self.write)


def _relabelled(labels: DataFrame, links: DataFrame, write: Write) -> DataFrame:
    """labels(rep, comp) after its components are joined by links(a, b) between reps."""
    of = lambda x: labels.select(F.col("rep").alias(x), F.col("comp").alias("c" + x))
    edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b")
    merged = components(edges, write).select(F.col("node").alias("comp"), F.col("comp").alias("new"))
    return write(labels.join(merged, "comp", "left").select("rep", F.coalesce("new", "comp").alias("comp")), "labels")


def link_classes(classes: DataFrame, docs: DataFrame, rule: Similarity, write: Write) -> DataFrame | None:
    """classes(rep, n, k1, key, signature) to (rep, comp) of every rep that shares a bucket; None if none does."""
    members = classes.select("rep", F.explode(bands_of(F.col("signature"), rule.rows)).alias("key"))
    multi = members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    state = write(members.join(multi, "key").select("key", "rep", "c"), "buckets")
    if state.isEmpty():
        return None
    # how many meetings a class has; the base of a group of edited copies has most
    fame = state.groupBy("rep").agg(F.sum("c").alias("fame"))
    nodes = write(classes.join(fame, "rep"), "nodes")
    state = write(state.select("key", "rep").join(nodes.select("rep", "fame"), "rep").select("key", "rep", "fame"), "famed")
    order = F.struct("fame", -F.col("rep"))
    verifier = Verifier(docs, nodes, rule, write)
    chosen = write(state.groupBy("key").agg(F.max_by("rep", order).alias("base")), "central")
    state = state.join(chosen, "key")
    tried = write(_ordered(state.where("rep <> base"), "rep", "base").distinct(), "pairs")
    labels = verifier.linked(nodes.select("rep", F.col("rep").alias("comp")), tried)
    # a bucket is open while it has members outside the component of its most central one
    here = state.select("base", "rep").distinct().join(labels, "rep").join(labels.select(F.col("rep").alias("base"), F.col("comp").alias("main")), "base")
    members = here.select("base", "rep", "comp", (F.col("comp") != F.col("main")).alias("outside"))
    members = write(members.join(members.where("outside").select("base").distinct(), "base", "left_semi"), "open")
    if members.isEmpty():
        return labels
    pairs = write(verifier.candidates(members).join(tried, ["a", "b"], "left_anti"), "pairs")
    if pairs.count() > MANY_PAIRS:
        # members of one group that no central member has linked: most are linked by the most central of their own
        ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("base")).union(pairs.select("b", "a"))
        best = ends.join(nodes.select(F.col("rep").alias("base"), "fame"), "base").groupBy("rep").agg(F.max_by("base", F.struct("fame", -F.col("base"))).alias("base"))
        labels = verifier.linked(labels, write(_ordered(best, "rep", "base").distinct(), "best"))
        of = lambda x: labels.select(F.col("rep").alias(x), F.col("comp").alias("c" + x))
        pairs = write(pairs.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select("a", "b"), "rest")
    return verifier.linked(labels, pairs)


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Pairs of two columns as (a, b), the lesser first."""
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def row_key(docs: DataFrame) -> Column:
    """A hash of a row's id and text."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def near_duplicates(docs: DataFrame, rule: Similarity = Similarity()) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id (least id of its group), kept.

    Null and empty texts, and texts without words, have no shingles and stand alone. Rows with equal sets are one
    class. Rows repeated whole keep the same component and verdict. Rows that share an id but not their text are judged each by its own text, and
    aren't linked by the id. A row without an id takes part like others; its component is the least id of its group, null if the group has none, and
    it is kept only in that case. Of docs only the two columns are read.
    """
    return _judged(docs, rule, materialise).drop("row_key")


def _judged(docs: DataFrame, rule: Similarity, write: Write) -> DataFrame:
    """near_duplicates() with row_key."""
    base = write(docs.select("doc_id", row_key(docs).alias("row_key"), sketch(F.col("text")).alias("s")).select("doc_id", "row_key", "s.*"), "sketches")
    found = base.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("least"), F.min("row_key").alias("key"), F.first("signature").alias("signature"))
    classes = write(found.withColumn("rep", F.monotonically_increasing_id()), "classes")  # numbers are settled by writing them
    reps = classes.select("k1", "k2", "n", "rep", "least")
    with scratch(docs.sparkSession) as for_now:
        labels = link_classes(classes.select("rep", "n", "k1", "key", "signature"), docs, rule, for_now)
        if labels is not None:
            named = labels.join(classes.select("rep", "least"), "rep")
            names = named.groupBy("comp").agg(F.min("least").alias("comp_id"))
            reps = reps.join(write(named.join(names, "comp").select("rep", "comp_id"), "components"), "rep", "left")
    reps = reps.withColumn("comp_id", F.coalesce("comp_id", "least") if labels is not None else F.col("least"))
    out = base.select("doc_id", "row_key", "n", "k1", "k2").join(reps.select("k1", "k2", "n", "comp_id"), ["k1", "k2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("comp_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "row_key", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, rule: Similarity = Similarity()) -> DataFrame:
    """The rows of docs, with their columns, whose document is kept; of rows that share an id and text one stays.

    Texts stay where they are: rows are judged by the keys of those to drop, broadcast up to BROADCAST_ROWS, and only rows repeated whole are shuffled.
    """
    key = free_name("_row_key", docs)

    def bounded(keys: DataFrame) -> DataFrame:
        keys = materialise(keys.select(F.col("row_key").alias(key)), "keys")
        return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys

    with scratch(docs.sparkSession) as write:
        judged = write(_judged(docs, rule, write).select("row_key", "kept"), "judged")
        gone = bounded(judged.where(~F.col("kept")).distinct())
        repeated = judged.where("kept").groupBy("row_key").count().where("count > 1")
        keys = None if repeated.isEmpty() else bounded(repeated)
    at = row_key(docs) == F.col(key)
    rows = docs.join(gone, at, "left_anti")
    if keys is None:
        return rows
    one = rows.join(keys, at, "left_semi").withColumn(key, row_key(docs)).dropDuplicates([key]).drop(key)
    return rows.join(keys, at, "left_anti").unionByName(one)
