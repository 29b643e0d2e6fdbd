"""Byte-level BPE encoding and decoding over an index of pair occurrences.

The texts of a run are cut into words as the vocabulary's pre-tokenizer cuts them. Words not met before are laid out as one array of symbols with
links to the symbol before and after; an index maps the rank of each pair to all the places where it occurs. The active ranks are applied in
ascending order, each at all its places at once, and every merge updates the lists of the pairs it makes. What words became is kept by a bounded
cache, so a word's ids are looked up for every later text. Words are told apart by 64-bit hashes there (two of a million differing words share
one with a probability of 3e-8).

One rank may be applied at all its places at once because no pair has a rank below those that make its two parts: Vocabulary checks that.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrain.llm import textkit as K

#: Words a worker keeps; the cache starts anew when full.
CACHE_WORDS = 1_000_000
#: Text bytes that are encoded at a time (one longer text is encoded whole), and ids that are decoded at a time.
RUN_BYTES, DECODE_IDS = 4 << 20, 1 << 18
LETTER, NUMBER, OTHER, BLANK = range(4)
#: Fixed value of the pattern: what may follow an apostrophe as a word of its own.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Letters and digits of Unicode 16.0, which the tokenizer knows and Python's tables of 15.1 lack.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
ROUND_TRIP = T.StructType([T.StructField("packed", T.BinaryType()), T.StructField("decoded", T.StringType())])


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, by rule: a visible Latin-1 character is itself, others follow from U+0100."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {**{chr(b): b for b in visible}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


def character_classes() -> np.ndarray:
    """LETTER, NUMBER, BLANK or OTHER of every code point."""
    kinds = np.full(0x110000, OTHER, np.int8)
    for code in range(0x110000):
        c = chr(code)
        group = unicodedata.category(c)[0]
        if group == "L":
            kinds[code] = LETTER
        elif group == "N":
            kinds[code] = NUMBER
        elif c.isspace() and not 0x1C <= code <= 0x1F:
            kinds[code] = BLANK
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for first, last in ranges:
            kinds[first : last + 1] = kind
    return kinds


class Vocabulary:
    """A parsed vocabulary file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")]
        if model["type"] != "BPE" or any(odd) or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("only byte-level BPE with its usual pattern and no normaliser, prefix space, dropout or unknown token is supported")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
            raise ValueError("only added tokens that match their plain text are supported")
        letters = byte_letters()
        ids = model["vocab"]
        #: Bytes of each id; added tokens are their own text.
        self.tokens = {i: bytes(letters[c] for c in t) for t, i in ids.items()} | {a["id"]: a["content"].encode() for a in added}
        self.added = {a["content"].encode(): a["id"] for a in added}
        self.byte_ids = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.width = 1 << max(max(self.tokens).bit_length(), 1)
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(pairs):
            made[a + b] = rank
        if any(made.get(part, -1) >= rank for rank, pair in enumerate(pairs) for part in pair):
            raise ValueError("a pair ranks below one that makes a part of it")
        keys = np.array([ids[a] * self.width + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.left, self.right = keys // self.width, keys % self.width
        self.joined = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.kinds = character_classes()

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; the number of ranks where they are no pair."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))


class PairIndex:
    """All places of each pair in the words of a run, by the pair's rank."""

    def __init__(self, vocabulary: Vocabulary, words: list[bytes]):
        self.v = vocabulary
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.firsts = np.cumsum(sizes) - sizes
        self.symbols = vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(self.symbols)
        self.after, self.before = np.arange(1, n + 1), np.arange(-1, n - 1)
        self.after[self.firsts + sizes - 1] = -1
        self.before[self.firsts] = -1
        self.alive = np.ones(n, bool)
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        first = np.flatnonzero(self.after >= 0)
        self._add(first)

    def _add(self, at: np.ndarray) -> None:
        """Note the pairs that begin at these places."""
        ranks = self.v.rank_of(self.symbols[at], self.symbols[self.after[at]])
        known = ranks < len(self.v.keys)
        ranks, at = ranks[known], at[known]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist(), len(at)]
        for a, b, rank in zip(starts, starts[1:], ranks[starts[:-1]].tolist(), strict=False):
            if rank in self.places:
                self.places[rank].append(at[a:b])
            else:
                self.places[rank] = [at[a:b]]
                heapq.heappush(self.active, rank)

    def merge(self) -> None:
        """Apply the active ranks, lowest first, until no pair is left."""
        symbols, after, before, alive = self.symbols, self.after, self.before, self.alive
        while self.active:
            rank = heapq.heappop(self.active)
            lists = self.places.pop(rank)
            left, right = self.v.left[rank], self.v.right[rank]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            second = after[at]
            good = alive[at] & (second >= 0) & (symbols[at] == left) & (symbols[second] == right)
            at, second = at[good], second[good]
            if left == right and len(at) > 1:
                # of a chain of overlapping pairs every other one is taken, from the left
                begins = np.concatenate([[True], second[:-1] != at[1:]])
                index = np.arange(len(at))
                take = (index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0
                at, second = at[take], second[take]
            if not len(at):
                continue
            symbols[at] = self.v.joined[rank]
            alive[second] = False
            beyond = after[second]
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            left_of = before[at]
            self._add(np.concatenate([left_of[left_of >= 0], at[inner]]))

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and the number of ids of each."""
        return self.symbols[self.alive], np.add.reduceat(self.alive.astype(np.int64), self.firsts)


class Encoder:
    """Cuts texts into words, merges those it has not met, and keeps what they became."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        longest = sorted(vocabulary.added, key=len, reverse=True)
        self.added = re.compile(b"(" + b"|".join(map(re.escape, longest)) + b")") if longest else None
        self.clear()

    def clear(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _kinds(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte's character."""
        kinds = self.v.kinds[:256][data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            first = data[lead].astype(np.int64)
            size = 2 + (first >= 0xE0) + (first >= 0xF0)
            code = first & (0x7F >> size)
            for k in (1, 2, 3):
                longer = size > k
                code[longer] = code[longer] << 6 | data[lead[longer] + k] & 0x3F
            kind = self.v.kinds[code]
            for k in range(4):
                longer = size > k
                kinds[lead[longer] + k] = kind[longer]
        return kinds

    def word_starts(self, data: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Where each word begins, cut as by 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ ; fresh marks the bytes where a text begins."""
        kinds = self._kinds(data)
        begins = fresh.copy()
        begins[1:] |= kinds[1:] != kinds[:-1]
        # the last blank before a word is split from those before it; a plain space then belongs to the word
        blank = kinds == BLANK
        last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~fresh[1:])
        begins[last[data[last] == 32] + 1] = False
        for _ in range(3):
            last = last - (data[last] & 0xC0 == 0x80)
        begins[last] = True
        # an apostrophe that begins a word takes an ending after it along, and a word begins after that
        marks = np.flatnonzero((data[:-1] == 39) & begins[:-1])
        for ending in ENDINGS:
            fits = marks[marks + len(ending) < len(data)]
            for k, c in enumerate(ending, 1):
                fits = fits[(data[fits + k] == ord(c)) & ~fresh[fits + k]]
            begins[fits + 1] = False
            behind = fits + len(ending) + 1
            begins[behind[behind < len(data)]] = True
        return np.flatnonzero(begins)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each text in the ids, and the ids."""
        parts, counts, whole = [], np.ones(len(texts), np.int64), []
        for i, t in enumerate(texts):
            if self.added is not None and self.added.search(t):
                cut = self.added.split(t)
                whole += range(len(parts) + 1, len(parts) + len(cut), 2)
                parts += cut
                counts[i] = len(cut)
            else:
                parts.append(t)
        data, offsets = K.batch_arrays(parts)
        if not len(data):
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint32)
        fresh = np.zeros(len(data) + 1, bool)
        fresh[offsets[:-1]] = True
        fresh = fresh[:-1]
        starts = self.word_starts(data, fresh)
        if whole:  # an added token is one word, which no cut text can be
            held = np.array(whole)
            of_part = np.searchsorted(offsets[held], starts, side="right") - 1
            starts = starts[(of_part < 0) | (starts == offsets[held][of_part]) | (starts >= offsets[held + 1][of_part])]
        ends = np.append(starts[1:], len(data))
        index = self._numbers(data, starts, ends)
        first, size = self.bounds[index], self.bounds[index + 1] - self.bounds[index]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        texts_end = offsets[np.cumsum(counts)]
        return np.concatenate([[0], total[np.searchsorted(starts, texts_end)]]), ids

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word in the cache, where new ones are put."""
        distinct, example, which = np.unique(K.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_WORDS:
            self.clear()
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == distinct
        new = np.flatnonzero(~known)
        number = np.empty(len(distinct), np.int64)
        number[known] = self.numbers[at[known]]
        if len(new):
            number[new] = len(self.bounds) - 1 + np.arange(len(new))
            raw, take = data.tobytes(), example[new]
            self._learn([raw[a:b] for a, b in zip(starts[take].tolist(), ends[take].tolist(), strict=True)])
            self.hashes, self.numbers = np.insert(self.hashes, at[new], distinct[new]), np.insert(self.numbers, at[new], number[new])
        return number[which]

    def _learn(self, words: list[bytes]) -> None:
        """Work out new words, which are numbered in this order."""
        special = np.fromiter((w in self.v.added for w in words), bool, len(words))
        sizes = np.ones(len(words), np.int64)
        ids = np.zeros(0, np.int64)
        if not special.all():
            pairs = PairIndex(self.v, [w for w in words if w not in self.v.added])
            pairs.merge()
            ids, sizes[~special] = pairs.result()
        ends = np.cumsum(sizes)
        flat, own = np.empty(ends[-1], np.uint32), np.zeros(ends[-1], bool)
        own[ends[special] - 1] = True
        flat[own] = [self.v.added[w] for w in words if w in self.v.added]
        flat[~own] = ids
        self.flat, self.bounds = np.concatenate([self.flat, flat]), np.concatenate([self.bounds, self.bounds[-1] + ends])


class Decoder:
    """Ids to text."""

    def __init__(self, vocabulary: Vocabulary):
        tokens = [vocabulary.tokens.get(i, b"") for i in range(max(vocabulary.tokens) + 1)]
        self.bytes, self.offsets = K.batch_arrays(tokens)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[str]:
        """The text of each run of ids: their bytes in a row, where each part that is no UTF-8 becomes U+FFFD. Ids that the vocabulary lacks are passed over."""
        first, ends = 0, bounds.tolist()
        while first < len(ends) - 1:
            last = first + 1
            while last < len(ends) - 1 and ends[last + 1] - ends[first] <= DECODE_IDS:
                last += 1
            part = ids[ends[first] : ends[last]].astype(np.int64)
            part = np.where((part >= 0) & (part < len(self.offsets) - 1), part, -1)
            begin = self.offsets[part]
            size = np.where(part < 0, 0, self.offsets[part + 1] - begin)
            total = np.concatenate([[0], np.cumsum(size)])
            raw = self.bytes[np.repeat(begin - total[:-1], size) + np.arange(total[-1])].tobytes()
            cuts = total[bounds[first : last + 1] - ends[first]].tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield raw[a:b].decode("utf-8", "replace")
            first = last


_tools: dict[str, tuple[Encoder, Decoder]] = {}


def tools(path: str) -> tuple[Encoder, Decoder]:
    """A vocabulary's encoder and decoder, one of each in a worker."""
    if path not in _tools:
        vocabulary = Vocabulary(path)
        _tools[path] = Encoder(vocabulary), Decoder(vocabulary)
    return _tools[path]


def _coded(texts: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """encode() of a batch in parts of about RUN_BYTES."""
    for _, part in K.chunked(texts.cast(pa.large_binary()).to_pylist(), RUN_BYTES):
        yield tools(path)[0].encode(part)


def encode(text: Column, path: str) -> Column:
    """The ids of each whole text; a null or empty text has none. The vocabulary file is at the same path on every executor."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(texts: pa.Array) -> pa.Array:
        parts = [pa.ListArray.from_arrays(pa.array(b, pa.int32()), pa.array(ids.astype(np.int32), pa.int32())) for b, ids in _coded(texts, path)]
        K.give_back()
        return pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *parts])

    return encoded(text)


def round_trip(text: Column, path: str) -> Column:
    """packed, the ids of each whole text as little-endian unsigned 32-bit integers in a row, and decoded, the text that they decode to; both empty for null and empty texts."""

    @F.arrow_udf(ROUND_TRIP)
    def both(texts: pa.Array) -> pa.Array:
        packed, decoded = [], []
        for bounds, ids in _coded(texts, path):
            raw, cuts = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
            packed += [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            decoded += tools(path)[1].decode(ids, bounds)
        K.give_back()
        return pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.array(decoded, pa.string())], ["packed", "decoded"])

    return both(text)


def decode(ids: Column, path: str) -> Column:
    """The text of an array of ids, added tokens included; a null or empty array is an empty text."""

    @F.arrow_udf(T.StringType())
    def decoded(arrays: pa.Array) -> pa.Array:
        flat = pa.compute.fill_null(arrays.flatten(), -1).to_numpy(zero_copy_only=False)
        sizes = pa.compute.fill_null(pa.compute.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
        return pa.array(tools(path)[1].decode(flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.string())

    return decoded(ids)
