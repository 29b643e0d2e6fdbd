"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded texts.

Folding lower-cases a text, maps homoglyphs of other scripts to Latin letters and digits or signs that stand for letters to
those letters, so that a disguised word meets its lexicon entry. The letters i and l and their stand-ins are one letter.
Hits inside an exception phrase don't count. A document's hits, weighted and set against its length, give its score.

Weights are learned from labels: words whose odds among toxic documents are high enter the lexicon beside the fixed ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrain.llm import textkit as K
from lodegrain.llm.common import scratch

#: General insults, known before any label.
SEED_WORDS = (
    "idiot", "idiots", "moron", "morons", "imbecile", "stupid", "dumbass", "retard", "scum", "scumbag", "trash", "garbage", "loser", "losers",
    "pathetic", "worthless", "disgusting", "clown", "clowns", "filth", "vermin", "bastard", "asshole", "bitch", "slut", "whore", "fuck", "fucking", "shit", "bullshit",
)
#: Phrases in which those words insult nobody.
EXCEPTIONS = ("trash can", "trash bin", "garbage collection", "garbage collector", "garbage truck", "clown fish", "pond scum", "pathetic fallacy", "sore loser rule", "stupid question bonus")
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "l", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g",
}
#: Digits that stand for letters anywhere in a word, and signs that do so between two word characters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e"}

#: Labelled rows the lexicon and the weights are learned from, at most: those with the least hashes.
FIT_ROWS = 24_000
#: A word enters the lexicon from this many unlike toxic documents and this log-odds on.
MIN_DOCS, MIN_ODDS = 4, 3.0
#: Learned words at most, by weight of evidence.
LEXICON_WORDS = 2_000
#: Weight of a fixed word that labels say nothing about.
SEED_WEIGHT = 4.0
#: Characters of a word that is looked at as a lexicon candidate.
WORD_CHARS = 40

RESULT = "struct<score: double, n_words: bigint, n_hits: bigint, weight: double, terms: array<string>>"

_TABLE = {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(k): v for k, v in DIGITS.items()} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {ord("l"): "i", ord("\n"): " ", ord("\t"): " ", ord("\r"): " ", 0x200B: None, 0x200D: None, 0xAD: None}
_SIGN = re.compile("(?<=[^\\W_])[" + re.escape("".join(SIGNS)) + "](?=[^\\W_])")
_SPACES = re.compile("  +")
_WORD = re.compile("[^\\W_]+")


def fold(text: str) -> str:
    """The form in which texts and lexicon meet."""
    text = text.lower()
    if any(s in text for s in SIGNS):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    text = text.translate(_TABLE)
    return _SPACES.sub(" ", text) if "  " in text else text


@dataclass(frozen=True)
class Lexicon:
    """Folded words and their weights, exception phrases, and the calibration of a score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: Intercept, and coefficients of log(1 + weight) and log(1 + weight per 100 words).
    curve: tuple[float, float, float] = (-4.0, 2.0, 2.0)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for w, weight in self.weights.items():
            a.add_word(w, (len(w), weight, w))
        for p in self.exceptions:
            a.add_word(fold(p), (len(fold(p)), None, fold(p)))
        if len(a):
            a.make_automaton()
        return a

    def probability(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        z = a + b * np.log1p(weight) + c * np.log1p(100 * weight / np.maximum(words, 1))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def hits(automaton: ahocorasick.Automaton, folded: str) -> list[tuple[int, str, float]]:
    """(place, word, weight) of every lexicon word that stands as a whole word and outside exception phrases."""
    found, spared = [], []
    if not len(automaton):
        return found
    for end, (n, weight, word) in automaton.iter(folded):
        start = end - n + 1
        if (start and folded[start - 1].isalnum()) or (end + 1 < len(folded) and folded[end + 1].isalnum()):
            continue
        if weight is None:
            spared.append((start, end))
        else:
            found.append((start, word, weight))
    return [h for h in found if not any(a <= h[0] <= b for a, b in spared)] if spared else found


def score(text: Column, lexicon: Lexicon) -> Column:
    """RESULT of each whole text. A null or empty text has no hits and gets the score of a clean text."""

    @F.arrow_udf(RESULT)
    def scored(texts: pa.Array) -> pa.Array:
        automaton = lexicon.automaton()
        n, counts, weights, terms = [], [], [], []
        for t in texts.to_pylist():
            found = hits(automaton, fold(t)) if t else []
            n.append(len(t.split()) if t else 0)
            counts.append(len(found))
            weights.append(sum(h[2] for h in found))
            terms.append(sorted({h[1] for h in found}))
        p = lexicon.probability(np.array(weights, float), np.array(n, float))
        K.give_back()
        return pa.StructArray.from_arrays(
            [pa.array(p), pa.array(n, pa.int64()), pa.array(counts, pa.int64()), pa.array(weights, pa.float64()), pa.array(terms, pa.list_(pa.string()))],
            ["score", "n_words", "n_hits", "weight", "terms"],
        )

    return scored(text)


@F.arrow_udf(T.StructType([T.StructField("sketch", T.LongType()), T.StructField("words", T.ArrayType(T.StringType()))]))
def _word_sets(texts: pa.Array) -> pa.Array:
    """Distinct folded words of each text, and a hash that near copies share: that of its three least word hashes."""
    sketches, words = [], []
    for t in texts.to_pylist():
        own = sorted({w for w in _WORD.findall(fold(t or "")) if len(w) <= WORD_CHARS})
        data, offsets = K.batch_arrays([w.encode() for w in own])
        low = np.sort(K.span_hashes(data, offsets[:-1], offsets[1:]))[:3] if own else np.zeros(0, np.uint64)
        sketches.append(int(np.bitwise_xor.reduce(low).astype(np.int64)) if len(low) else 0)
        words.append(own)
    K.give_back()
    return pa.StructArray.from_arrays([pa.array(sketches, pa.int64()), pa.array(words, pa.list_(pa.string()))], ["sketch", "words"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Lexicon:
    """A lexicon learned from docs(doc_id, text) and labels(doc_id, toxic); the fixed one if no row is labelled.

    Only documents that have a non-null label are read. Documents with several labels count with each. Copies of a document count once for a word's odds.
    """
    with scratch(docs.sparkSession) as write:
        return _fit(docs, labels, fit_rows, write)


def _fit(docs: DataFrame, labels: DataFrame, fit_rows: int, write: Callable[[DataFrame, str], DataFrame]) -> Lexicon:
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(fit_rows)
    # fit_rows bounds both the ids that are broadcast and the texts that are kept for the passes below
    rows = write(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("toxic", "text"), "labelled")
    spread = rows.select("toxic", _word_sets(F.col("text")).alias("s"))
    pairs = spread.select("toxic", "s.sketch", F.explode("s.words").alias("word")).distinct()
    sizes = {r["toxic"]: r["n"] for r in spread.groupBy("toxic").agg(F.countDistinct("s.sketch").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    weights = {fold(w): SEED_WEIGHT for w in SEED_WORDS}
    if not bad or not good:
        return Lexicon(weights)
    counts = pairs.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("n"))
    odds = F.log((F.col("p") + 0.1) / F.lit(bad + 0.2)) - F.log((F.col("n") + 0.1) / F.lit(good + 0.2))
    learned = counts.where(F.col("p") >= MIN_DOCS).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS)
    top = learned.orderBy((F.col("p") * F.col("odds")).desc(), "word").limit(LEXICON_WORDS).collect()
    weights |= {r["word"]: float(min(r["odds"], 8.0)) for r in top}
    lexicon = Lexicon(weights)
    seen = rows.select("toxic", score(F.col("text"), lexicon).alias("r")).select("toxic", "r.weight", "r.n_words").toPandas()
    return Lexicon(weights, EXCEPTIONS, calibrate(seen["weight"].to_numpy(), seen["n_words"].to_numpy(), seen["toxic"].to_numpy()))


def calibrate(weight: np.ndarray, words: np.ndarray, toxic: np.ndarray, steps: int = 40, ridge: float = 1.0) -> tuple[float, float, float]:
    """Ridge logistic regression of toxic on Lexicon.probability's two terms, by Newton steps."""
    x = np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 1))], 1)
    w = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = x.T * (p * (1 - p)) @ x + np.diag([1e-6, ridge, ridge])
        step = np.linalg.solve(h, x.T @ (toxic - p) - np.array([0, ridge, ridge]) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def keep_clean(docs: DataFrame, lexicon: Lexicon, limit: float = 0.5) -> DataFrame:
    """The rows of docs, with their columns, that score below the limit; null and empty texts stay."""
    return docs.where(score(F.col("text"), lexicon)["score"] < limit)
