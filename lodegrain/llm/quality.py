"""Quality rules and an isolation forest over their statistics.

Rule statistics of whole texts are computed in numpy over Arrow batches. The forest is grown from a bounded sample; a
document's score follows from the mean path length at which random splits isolate it. The threshold is calibrated on the
histogram of scores of all labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrain.llm import textkit as K
from lodegrain.llm.common import materialise, scratch

#: The forest grows from this many documents at most: those with the least hashes.
FIT_ROWS = 16_384
TREES, SUBSAMPLE = 128, 256
REPEAT_WIDTH = 8
#: Text bytes of a numpy run.
RUN_BYTES = 1 << 19
#: Score bins for the calibration.
BINS = 2000
#: A kept document that should go costs 1; a clean one that goes costs this.
KEEP_WEIGHT = 4.0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest sees: how far each rule statistic lies outside its usual range (log(1 + distance), as a mean word length has no upper end), 0 inside. Ordinary documents thus
#: coincide, where random splits can't part them, and every broken rule is a direction that isolates.
FEATURES = ("mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "pipe_share", "plain_share", "type_share", "echo_share")
LOW = (3.5, 0, 0, 0, 0, 0, 0, 0, 0.6, 0.1, 0)
HIGH = (10, 0.05, 0.4, 0.3, 0.3, 0.3, 0.05, 0.1, 1, 1, 0.1)
STAT_TYPE = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ", features: array<float>>"

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER, _DIGIT, _MARK, _LETTER = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[list(b"!?")] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def text_stats(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (integers) and FEATURES (floats) of each text."""
    data, offsets = K.batch_arrays(parts)
    n = len(parts)
    own_sum = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])
    starts, ends, own = K.word_spans(data, offsets)
    words = np.bincount(own, minlength=n).astype(np.int64)
    runes = (data & 0xC0) != 0x80
    space = K.IS_SPACE[data] if len(data) else np.zeros(0, bool)
    chars = own_sum(runes & ~space)
    symbols = own_sum(_SYMBOLS[data])
    ls, le, lo = K.line_spans(data, offsets)
    has_word = np.diff(np.searchsorted(starts, np.stack([ls, le], 1)), axis=1)[:, 0] > 0
    ls, le, lo = ls[has_word], le[has_word], lo[has_word]
    lines = np.bincount(lo, minlength=n)
    dup_lines = np.bincount(lo[_repeats(lo, K.span_hashes(data, ls, le), first=False)], minlength=n).astype(np.int64)
    hashes = K.span_hashes(data, starts, ends)
    runs, first = K.windows(hashes, own, REPEAT_WIDTH)
    again = first[_repeats(own[first], runs, first=True)]
    cover = np.zeros(len(own) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + REPEAT_WIDTH, -1)
    repeat = np.bincount(own[np.cumsum(cover[:-1]) > 0], minlength=n).astype(np.int64)
    counts = np.stack([words, chars, symbols, dup_lines, repeat], 1)
    total, letters = np.maximum(chars, 1), np.maximum(own_sum(_LETTER[data] & runes), 1)
    some = np.maximum(words, 1)
    plain = np.bincount(own[_LETTER[data[ends - 1]]], minlength=n) if len(own) else np.zeros(n)
    distinct = np.bincount(own[~_repeats(own, hashes, first=False)], minlength=n)
    measured = np.stack(
        [
            chars / some, symbols / total, dup_lines / np.maximum(lines, 1), repeat / some, own_sum(_UPPER[data]) / letters, own_sum(_DIGIT[data]) / total, own_sum(_MARK[data]) / total,
            own_sum(data == 124) / some, np.where(words > 0, plain / some, 1.0), np.where(words > 0, distinct / some, 1.0),
            np.bincount(own[1:][(own[1:] == own[:-1]) & (hashes[1:] == hashes[:-1])], minlength=n) / some,
        ], 1,
    )
    features = np.log1p(np.maximum(LOW - measured, 0) + np.maximum(measured - HIGH, 0)) * (words > 0)[:, None]
    return counts, features.astype(np.float32)


def _repeats(own: np.ndarray, hashes: np.ndarray, first: bool) -> np.ndarray:
    """Marks items whose hash occurs more than once in their text; without the first of them if not first."""
    out = np.zeros(len(own), bool)
    if len(own):
        key = K.mix(hashes ^ (own.astype(np.uint64) + np.uint64(1)) * K.STEP)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        out[order[1:][same]] = True
        if first:
            out[order[:-1][same]] = True
    return out


def _stat_array(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    counts, features = [np.zeros((0, len(COUNTS)), np.int64)], [np.zeros((0, len(FEATURES)), np.float32)]
    for _, run in K.chunked(texts.cast(pa.binary()).to_pylist(), RUN_BYTES):
        c, f = text_stats(run)
        counts.append(c)
        features.append(f)
    K.give_back()
    return np.concatenate(counts), np.concatenate(features)


def rule_stats(text: Column) -> Column:
    """A struct of COUNTS and the feature vector of each whole text; null is an empty text."""

    @F.arrow_udf(STAT_TYPE)
    def stats(texts: pa.Array) -> pa.Array:
        counts, features = _stat_array(texts)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(features.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
        return pa.StructArray.from_arrays([*(pa.array(counts[:, i]) for i in range(len(COUNTS))), flat], [*COUNTS, "features"])

    return stats(text)


@dataclass(frozen=True)
class Forest:
    """Trees as arrays (trees x nodes): feature or -1 at a leaf, split value, left child; depth holds a leaf's path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    norm: float
    threshold: float = 0.5

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected length): near 1 is isolated early."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, value, left, depth in zip(self.feature, self.value, self.left, self.depth, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.ceil(np.log2(SUBSAMPLE))) + 1):
                f = feature[at]
                at = np.where(f < 0, at, left[at] + (x[rows, np.maximum(f, 0)] >= value[at]))
            total += depth[at]
        return np.exp2(-total / len(self.feature) / self.norm)


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n values."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(sample: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7) -> Forest:
    """An isolation forest over rows of features; of an empty or constant sample, one that finds nothing odd."""
    rng = np.random.default_rng(seed)
    limit, size = int(np.ceil(np.log2(max(subsample, 2)))), 2 ** (int(np.ceil(np.log2(max(subsample, 2)))) + 1)
    feature, value, left, depth = np.full((trees, size), -1), np.zeros((trees, size), np.float32), np.zeros((trees, size), np.int64), np.zeros((trees, size))
    for t in range(trees):
        rows = sample[rng.choice(len(sample), min(subsample, len(sample)), replace=False)] if len(sample) else sample
        used, todo = 1, [(0, rows, 0)]
        while todo:
            node, part, deep = todo.pop()
            spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 else np.zeros(0, int)
            if deep >= limit or not len(spread):
                depth[t, node] = deep + _expected(len(part))
                continue
            f = rng.choice(spread)
            lo, hi = part[:, f].min(), part[:, f].max()
            cut = np.float32(rng.uniform(lo, hi))
            cut = hi if cut <= lo else cut
            feature[t, node], value[t, node], left[t, node] = f, cut, used
            right = part[:, f] >= cut
            todo += [(used, part[~right], deep + 1), (used + 1, part[right], deep + 1)]
            used += 2
    return Forest(feature, value, left, depth, max(_expected(min(subsample, max(len(sample), 2))), 1e-9))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """The two fixed rules: fewer than 20 words, or over 30 % of the words in repeated windows."""
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def score_of(forest: Forest, features: Column) -> Column:
    """The forest's score of each feature vector."""

    @F.arrow_udf("double")
    def scored(vectors: pa.Array) -> pa.Array:
        flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        return pa.array(forest.scores(flat))

    return scored(features)


def calibrate(histogram: list[tuple[int, int, int]], keep_weight: float = KEEP_WEIGHT) -> float:
    """The score above which documents go, from (bin, quality, count) of labelled rows: least weighted error; 1 if no row is labelled."""
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for b, quality, n in histogram:
        (good if quality else bad)[min(max(b, 0), BINS - 1)] += n
    if not bad.sum() or not good.sum():
        return 1.0
    lost = good[::-1].cumsum()[::-1] * keep_weight
    missed = np.concatenate([[0], bad.cumsum()[:-1]])
    cost = lost + missed
    best = np.flatnonzero(cost == cost.min())
    return float(best[len(best) // 2] / BINS)


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Forest:
    """Forest and threshold from stats(doc_id, stats) and labels(doc_id, quality).

    The sample is the fit_rows rows with the least hash of their id and features. Rows that the fixed rules reject are not
    sampled nor used for the threshold. Documents with several labels count with each; null labels are left out.
    """
    left = stats.where(~base_failed(F.col("stats.n_words"), F.col("stats.n_repeat_words")))
    sample = left.select(F.xxhash64("doc_id", "stats.features").alias("h"), "stats.features").orderBy("h", "features").limit(fit_rows).collect()
    forest = grow(np.array([r.features for r in sample], np.float32).reshape(-1, len(FEATURES)))
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality")
    scored = left.join(known, "doc_id").select("quality", F.floor(score_of(forest, F.col("stats.features")) * BINS).cast("int").alias("bin"))
    histogram = scored.groupBy("bin", "quality").count().collect()
    return Forest(forest.feature, forest.value, forest.left, forest.depth, forest.norm, calibrate([(r["bin"], r["quality"], r["count"]) for r in histogram]))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, COUNTS, base_failed, score and kept.

    Null texts have no words and fail the fixed rules, as empty ones do. Repeated rows are judged alike; a null doc_id is
    judged like others. Columns of docs other than doc_id and text are not read.
    """
    stats = materialise(docs.select("doc_id", rule_stats(F.col("text")).alias("stats")), "stats")
    forest = fit(stats, labels)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    out = stats.select("doc_id", *(F.col(f"stats.{c}").alias(c) for c in COUNTS), score_of(forest, F.col("stats.features")).alias("score"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") < forest.threshold))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, that judge() keeps. Statistics are computed once for the fit and once for the verdict, so texts are not shuffled."""
    with scratch(docs.sparkSession) as write:
        forest = fit(write(docs.select("doc_id", rule_stats(F.col("text")).alias("stats")), "stats"), labels)

    @F.arrow_udf("boolean")
    def verdict(texts: pa.Array) -> pa.Array:
        counts, features = _stat_array(texts)
        failed = (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])
        return pa.array(~failed & (forest.scores(features) < forest.threshold))

    return docs.where(verdict(F.col("text")))
