"""SentencePiece BPE encoding with byte spans in the original text, and decoding, in whole Arrow batches.

A text is normalised by longest-prefix matches in the model's compiled character map, and every normalised byte records
the source byte it came from; each piece is projected through that record. Merges never cross a pair of characters that no piece
holds, so the normalised text falls into words whose pieces are worked out once and kept by a bounded cache; ids and spans
of a batch are then gathered in numpy.

The working form keeps a normalised space as one byte: pieces write it as U+2581, and so does a text that contains that character.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrain.llm import textkit as K

#: Fixed values of the model format: piece types and the visible space.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
SPACE = "▁"
NEVER = float("-inf")
#: Words a worker keeps; the cache starts anew when full.
CACHE_WORDS = 100_000
#: Ids that are decoded at a time (one longer text is decoded whole).
DECODE_IDS = 1 << 17
#: Words longer than this are merged with a heap, shorter ones together in numpy.
SHORT_WORD = 48
#: Text bytes that are encoded at a time (one longer text is encoded whole).
RUN_BYTES = 1 << 18
ENCODED = T.StructType([T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "begins", "ends")])
ROUND_TRIP = T.StructType([*ENCODED.fields, T.StructField("decoded", T.StringType())])


def fields_of(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield tag >> 3, struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0]
            at += n


class CharacterMap:
    """The compiled character map: a double-array trie from source to replacement strings, both in UTF-8."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(length, value) of the longest key that data has at a place; length 0 if none."""
        best, node, units = (0, 0), 0, self.units
        if not units:
            return best
        jump = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = jump(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= jump(unit)
            if unit & 256:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return best

    def replacement(self, value: int) -> bytes:
        return self.strings[value : self.strings.index(b"\0", value)]


@dataclass
class Model:
    """A parsed BPE model file."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = 1
    byte_fallback: bool = False
    suffix_space: bool = False
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    unk_surface: str = " ⁇ "
    chars: CharacterMap = field(default_factory=lambda: CharacterMap(b""))

    @classmethod
    def load(cls, path: str) -> Model:
        m = cls()
        with open(path, "rb") as f:
            data = f.read()
        for number, value in fields_of(data):
            if number == 1:
                piece = dict(fields_of(value))
                m.pieces.append(piece[1].decode())
                m.scores.append(piece.get(2, 0.0))
                m.types.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(fields_of(value))
                m.kind, m.byte_fallback, m.suffix_space = spec.get(3, 1), bool(spec.get(35, 0)), bool(spec.get(24, 0))
                m.unk_surface = spec[44].decode() if 44 in spec else m.unk_surface
            elif number == 3:
                spec = dict(fields_of(value))
                m.chars = CharacterMap(spec.get(2, b""))
                m.dummy_prefix, m.squeeze, m.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if m.kind != BPE or m.suffix_space or not m.escape or {USER, UNUSED} & set(m.types):
            raise ValueError("only BPE models with leading, visible spaces and without user-defined or unused pieces are supported")
        return m

    def normalise(self, text: bytes) -> tuple[str, np.ndarray | None]:
        """The working form and, for each of its bytes and its end, the source byte; None where source is place - 1 (an identity map)."""
        if not text:
            return "", None
        if not self.chars.units and not self.squeeze:
            return (" " if self.dummy_prefix else "") + text.decode("utf-8", "replace"), None if self.dummy_prefix else np.arange(len(text) + 1)
        out, source, at = [], [], 0

        def put(piece: bytes, place: int) -> None:
            out.append(piece)
            source.extend([place] * len(piece))

        if self.dummy_prefix:
            put(b" ", 0)
        while at < len(text):
            n, value = self.chars.longest(text, at)
            if n:
                piece = self.chars.replacement(value)
            else:
                n = 1
                while at + n < len(text) and text[at + n] & 0xC0 == 0x80:
                    n += 1
                piece = text[at : at + n]
            if self.squeeze:
                while piece[:1] == b" " and (not out or out[-1][-1:] == b" "):
                    if len(out) == 1 and self.dummy_prefix:
                        source[0] = at + n  # leading spaces belong to no piece
                    piece = piece[1:]
            if piece:
                put(piece, at)
            at += n
        if self.squeeze:
            while out and out[-1][-1:] == b" ":
                place = source.pop()
                out[-1] = out[-1][:-1]
                at = place
                if not out[-1]:
                    out.pop()
        if not out:
            return "", None
        source.append(at)
        return b"".join(out).decode("utf-8", "replace"), np.array(source)


class Numbers(dict):
    """The number of each word; a word that is looked up for the first time gets the next one and is noted as fresh."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


class Encoder:
    """Merges words of one model and keeps what it has merged."""

    def __init__(self, model: Model):
        self.model = model
        self.rank = {p: s for p, s, t in zip(model.pieces, model.scores, model.types, strict=True) if t == NORMAL}
        self.ids = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == BYTE}
        self.unk = next(i for i, t in enumerate(model.types) if t == UNKNOWN)
        pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        # words end before a run of spaces if no piece has a space after another character
        inner = any(b == SPACE and a != SPACE for a, b in pairs)
        loose = [c for c in "\n\t" if not any(c in p for p in self.rank if len(p) > 1)]
        stop = "".join(loose)
        self.words = re.compile("(?s:.+)" if inner else f"[ {SPACE}]*[^ {SPACE}{stop}]+|[ {SPACE}]+|[{stop}]" if stop else f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
        #: Source bytes of each piece, where a visible space was one byte.
        self.sizes = [len(p.replace(SPACE, " ").encode()) for p in model.pieces]
        # every way to join two pieces into a third: keys of both ids, in order, and the joined id
        joins = {(self.ids[p[:i]] << 16 | self.ids[p[i:]]): own for p, own in self.ids.items() for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids}
        self.join_keys = np.array(sorted(joins), np.int64)
        self.join_ids = np.array([joins[k] for k in self.join_keys.tolist()], np.int32)
        self.scores = np.array(model.scores)
        self.char_ids = np.full(0x110000, -1, np.int32)
        for p, own in self.ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = own
        self.size_table = np.array(self.sizes, np.int32)
        self.clear()

    def clear(self) -> None:
        self.cache = Numbers()
        self.flat_ids, self.flat_lens, self.bounds = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def merge(self, word: str) -> list[str]:
        """Pieces of a word: the best-scored adjacent pair first, the leftmost of equals."""
        symbols, rank = list(word), self.rank
        if len(symbols) > SHORT_WORD:
            return self._merge_long(symbols)
        best = [rank.get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while best:
            top = max(best)
            if top == NEVER:
                break
            i = best.index(top)
            symbols[i] += symbols.pop(i + 1)
            del best[i]
            if i < len(best):
                best[i] = rank.get(symbols[i] + symbols[i + 1], NEVER)
            if i:
                best[i - 1] = rank.get(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def _merge_long(self, symbols: list[str | None]) -> list[str]:
        after, before, rank = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1)), self.rank
        heap = [(-rank[symbols[i] + symbols[i + 1]], i, symbols[i] + symbols[i + 1]) for i in range(len(symbols) - 1) if symbols[i] + symbols[i + 1] in rank]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if symbols[i] is not None else len(symbols)
            if j >= len(symbols) or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j], after[i] = joined, None, after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(symbols) and (pair := symbols[a] + symbols[b]) in rank:
                    heapq.heappush(heap, (-rank[pair], a, pair))
        return [s for s in symbols if s is not None]

    def _pieces_of(self, word: str) -> tuple[list[int], list[int]]:
        """A word's ids and source byte lengths, with bytes or the unknown piece for characters that no piece has."""
        shown = word.replace(" ", SPACE)
        pieces = self.merge(shown) if len(shown) > 1 else [shown]
        ids, lens, at = [], [], 0
        for p in pieces:
            size = len(word[at : at + len(p)].encode())
            at += len(p)
            if (own := self.ids.get(p)) is not None:
                ids.append(own)
                lens.append(size)
            elif self.model.byte_fallback:
                raw = p.encode()
                ids += [self.bytes[b] for b in raw]
                lens += [0] * (len(raw) - 1) + [size]
            elif ids and ids[-1] == self.unk:
                lens[-1] += size  # runs of unknown characters are one piece
            else:
                ids.append(self.unk)
                lens.append(size)
        return ids, lens

    def _joined(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joined ids and scores of pairs of ids; the score is -inf where they don't join."""
        key = a.astype(np.int64) << 16 | b
        at = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
        hit = (self.join_keys[at] == key) & (a >= 0) & (b >= 0)
        ids = self.join_ids[at]
        return ids, np.where(hit, self.scores[ids], NEVER)

    def _merge_all(self, rows: np.ndarray) -> np.ndarray:
        """merge() of many words at once: rows of character ids, filled up with -1, to rows of piece ids."""
        out, live, m = rows.copy(), np.arange(len(rows)), rows
        joined, score = self._joined(m[:, :-1], m[:, 1:])
        columns = np.arange(m.shape[1])
        while len(live):
            best = score.argmax(1)
            act = score[np.arange(len(live)), best] > NEVER
            out[live[~act]] = m[~act]
            live, m, joined, score, best = live[act], m[act], joined[act], score[act], best[act]
            if not len(live):
                break
            n = np.arange(len(live))
            m[n, best] = joined[n, best]
            take = np.minimum(columns + (columns > best[:, None]), m.shape[1] - 1)
            m = np.take_along_axis(m, take, 1)
            m[:, -1] = -1
            pairs = np.minimum(columns[:-1] + (columns[:-1] > best[:, None]), m.shape[1] - 2)
            joined, score = np.take_along_axis(joined, pairs, 1), np.take_along_axis(score, pairs, 1)
            score[:, -1] = NEVER
            for at in (best - 1, best):
                ok = (at >= 0) & (at < m.shape[1] - 1)
                r, c = n[ok], at[ok]
                joined[r, c], score[r, c] = self._joined(m[r, c], m[r, c + 1])
        return out

    def _add_all(self, fresh: list[str]) -> None:
        """Put the ids and source byte lengths of new words, already numbered in this order, into the store."""
        count, parts = np.zeros(len(fresh), np.int64), []
        lengths = np.fromiter(map(len, fresh), np.int64, len(fresh))
        codes = np.frombuffer("".join(fresh).replace(" ", SPACE).encode("utf-32-le"), "<u4")
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        chars = self.char_ids[codes]
        plain = (np.minimum.reduceat(chars, bounds[:-1]) >= 0) & (lengths <= SHORT_WORD) & np.fromiter((SPACE not in w for w in fresh), bool, len(fresh))
        low = 0
        for high in (6, 9, 12, 16, 24, SHORT_WORD):
            pick = np.flatnonzero(plain & (lengths > low) & (lengths <= high))
            low = high
            if len(pick):
                columns = np.arange(max(high, 2))
                inside = columns < lengths[pick, None]
                rows = np.where(inside, chars[np.minimum(bounds[pick, None] + columns, len(chars) - 1)], -1)
                done = self._merge_all(rows)
                ids = done[done >= 0]
                count[pick] = (done >= 0).sum(1)
                parts.append((pick, ids, self.size_table[ids]))
        slow = np.flatnonzero(~plain)
        for i in slow.tolist():
            ids, lens = self._pieces_of(fresh[i])
            count[i] = len(ids)
            parts.append((np.array([i]), np.array(ids, np.int32), np.array(lens, np.int32)))
        starts = np.concatenate([[0], np.cumsum(count)])
        ids, lens = np.empty(starts[-1], np.int32), np.empty(starts[-1], np.int32)
        for pick, own_ids, own_lens in parts:
            n = count[pick]
            place = np.repeat(starts[pick] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(own_ids))
            ids[place], lens[place] = own_ids, own_lens
        self.flat_ids, self.flat_lens = np.concatenate([self.flat_ids, ids]), np.concatenate([self.flat_lens, lens])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + starts[1:]])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token bounds of each text, ids, and begins and ends of each token in bytes of its text."""
        if len(self.cache) > CACHE_WORDS:
            self.clear()
        at, sizes, maps, number = [np.zeros(0, np.int64)], [], [], self.cache.__getitem__
        for t in texts:
            form, source = self.model.normalise(t)
            words = self.words.findall(form)
            at.append(np.fromiter(map(number, words), np.int64, len(words)))
            sizes.append(len(words))
            maps.append(source)
        if self.cache.fresh:
            self._add_all(self.cache.fresh)
            self.cache.fresh = []
        index = np.concatenate(at)
        first, n = self.bounds[index], self.bounds[index + 1] - self.bounds[index]
        total = np.concatenate([[0], np.cumsum(n)])
        gather = np.repeat(first - total[:-1], n) + np.arange(total[-1])
        ids, lens = self.flat_ids[gather], self.flat_lens[gather]
        bounds = total[np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])]
        ends = np.cumsum(lens, dtype=np.int64)
        base = np.repeat(np.concatenate([[0], ends])[bounds[:-1]], np.diff(bounds))
        ends -= base
        begins = ends - lens
        for t, source in enumerate(maps):
            if source is not None:
                part = slice(bounds[t], bounds[t + 1])
                begins[part], ends[part] = source[begins[part]], source[ends[part]]
        if all(s is None for s in maps):
            begins, ends = np.maximum(begins - 1, 0), np.maximum(ends - 1, 0)
        else:
            for t, source in enumerate(maps):
                if source is None:
                    part = slice(bounds[t], bounds[t + 1])
                    begins[part], ends[part] = np.maximum(begins[part] - 1, 0), np.maximum(ends[part] - 1, 0)
        return bounds, ids, begins.astype(np.int32), ends.astype(np.int32)


class Decoder:
    """Ids to text."""

    def __init__(self, model: Model):
        self.model = model
        raw = []
        for p, t in zip(model.pieces, model.types, strict=True):
            raw.append(b"" if t == CONTROL else model.unk_surface.encode() if t == UNKNOWN else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode())
        self.bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        kinds = np.array(model.types)
        self.opens = np.array([p.startswith(SPACE) for p in model.pieces]) & (kinds == NORMAL) & (model.dummy_prefix or model.squeeze)
        self.is_byte, self.is_control = kinds == BYTE, kinds == CONTROL

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[str]:
        """The text of each run of ids. The first piece loses its leading space; bytes that are not UTF-8 become U+FFFD one by one.

        Runs are decoded some at a time, as the place of every byte is looked up in one array.
        """
        ends, first = bounds[1:].tolist(), 0
        start = int(bounds[0]) if len(bounds) else 0
        while first < len(ends):
            last = first + 1
            while last < len(ends) and ends[last] - start <= DECODE_IDS:
                last += 1
            yield from self._decode_part(ids[start : ends[last - 1]], bounds[first : last + 1] - start)
            start, first = ends[last - 1], last

    def _decode_part(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[str]:
        n = self.bounds[ids + 1] - self.bounds[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        data = self.bytes[np.repeat(self.bounds[ids] - total[:-1], n) + np.arange(total[-1])].tobytes()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            k = a
            while k < b and self.is_control[ids[k]]:
                k += 1
            lead = 1 if k < b and self.opens[ids[k]] else 0
            part = data[total[a] + lead : total[b]]
            try:
                yield part.decode()
            except UnicodeDecodeError:
                yield self._patched(part)

    @staticmethod
    def _patched(data: bytes) -> str:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_models: dict[str, Model] = {}
_encoders: dict[str, Encoder] = {}
_decoders: dict[str, Decoder] = {}


def _model(path: str) -> Model:
    """A model file's content, which a worker's encoder and decoder share."""
    if path not in _models:
        _models[path] = Model.load(path)
    return _models[path]


def _encoder(path: str) -> Encoder:
    """A model's encoder, one in a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(_model(path))
    return _encoders[path]


def _decoder(path: str) -> Decoder:
    """A model's decoder, one in a worker."""
    if path not in _decoders:
        _decoders[path] = Decoder(_model(path))
    return _decoders[path]


def _lists(offsets: pa.Array, values: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *values]), pa.int32()))


def _encoded(texts: pa.Array, model_path: str, back: bool) -> pa.Array:
    """ENCODED, or with back ROUND_TRIP, of each text; runs of texts are encoded and decoded at a time."""
    tool, bounds, cols, decoded = _encoder(model_path), [np.zeros(1, np.int64)], [[], [], []], []
    for _, run in K.chunked(texts.cast(pa.binary()).to_pylist(), RUN_BYTES):
        b, *values = tool.encode(run)
        bounds.append(b[1:] + bounds[-1][-1])
        for c, v in zip(cols, values, strict=True):
            c.append(v)
        if back:
            decoded.append(pa.array(_decoder(model_path).decode(values[0], b), pa.string()))
    offsets = pa.array(np.concatenate(bounds).astype(np.int32))
    fields = [_lists(offsets, c) for c in cols]
    if back:
        fields.append(pa.concat_arrays([pa.array([], pa.string()), *decoded]))
    K.give_back()
    return pa.StructArray.from_arrays(fields, [f.name for f in (ROUND_TRIP if back else ENCODED)])


def encode(text: Column, model_path: str) -> Column:
    """ids, begins and ends (bytes of the text's UTF-8) of each whole text; a null or empty text has no tokens. The model file is at the same path on every executor."""

    @F.arrow_udf(ENCODED)
    def encoded(texts: pa.Array) -> pa.Array:
        return _encoded(texts, model_path, False)

    return encoded(text)


def round_trip(text: Column, model_path: str) -> Column:
    """encode() with decoded, the text that decode() makes of the ids, in one pass: a task needs one Python worker for both."""

    @F.arrow_udf(ROUND_TRIP)
    def both(texts: pa.Array) -> pa.Array:
        return _encoded(texts, model_path, True)

    return both(text)


def encode_ids(text: Column, model_path: str) -> Column:
    """The ids of encode() alone, for uses that need no spans."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(texts: pa.Array) -> pa.Array:
        return _encoded(texts, model_path, False).field("ids")

    return encoded(text)


def decode(ids: Column, model_path: str) -> Column:
    """The text of an array of ids; a null or empty array is an empty text."""

    @F.arrow_udf(T.StringType())
    def decoded(arrays: pa.Array) -> pa.Array:
        flat = arrays.flatten().to_numpy(zero_copy_only=False)
        sizes = pa.compute.fill_null(pa.compute.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
        return pa.array(_decoder(model_path).decode(flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.string())

    return decoded(ids)
