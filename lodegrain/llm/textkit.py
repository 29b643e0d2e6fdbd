"""Whole-batch text kernels in numpy: word spans, line spans and 64-bit hashes over one UTF-8 buffer of many texts.

Words are runs of bytes other than the six ASCII white space characters, as in [^\\x20\\x09-\\x0D]+. Hashes are
polynomials modulo 2**64 over a random table of byte values, finished by a mixer; equal byte strings have equal hashes and
others differ but for chance (about n*n / 2**65 for n strings).
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240611))
#: A random value for each byte, and the same for texts read with A-Z in lower case.
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
#: Segment hashes are combined with this odd factor.
STEP = np.uint64(0xD1342543DE82EF95)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = 1 << max(n - 1, 1).bit_length()
        _powers = np.full(n, BASE, np.uint64)
        _inverses = np.full(n, BASE_INVERSE, np.uint64)
        _powers[0] = _inverses[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
        np.multiply.accumulate(_inverses, out=_inverses)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Hashes of data[start:end] for each span."""
    n = len(data)
    _grow(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * _powers[:n], out=prefix[1:])
    sums = (prefix[ends] - prefix[starts]) * _inverses[starts]
    return mix(sums ^ (ends - starts).astype(np.uint64) * STEP)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends and text number of every word; offsets has the texts' bounds in data. Words never cross texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~IS_SPACE[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens[inner] = solid[inner]
    closes[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends and text number of every \\n-split line; an empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    of_break = np.searchsorted(offsets, breaks, side="right") - 1
    n = len(offsets) - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    own = np.concatenate([np.arange(n), of_break])
    order = np.lexsort((starts, own))
    # the i-th end of a text closes its i-th start; both lists are sorted by text and place
    order_ends = np.lexsort((ends, np.concatenate([of_break, np.arange(n)])))
    return starts[order], ends[order_ends], own[order]


def windows(hashes: np.ndarray, own: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of width words within one text, and the index of the run's first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = hashes[:n].copy()
    for k in range(1, width):
        total *= STEP
        total += hashes[k : k + n]
    first = np.flatnonzero(own[:n] == own[width - 1 :])
    return mix(total[first]), first


def batch_arrays(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of many texts and their bounds."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)), out=offsets[1:])
    return data, offsets


def chunked(texts: list[bytes | None], limit: int = 2 << 20) -> list[tuple[int, list[bytes]]]:
    """(first index, texts) runs of about limit bytes; nulls are empty. A longer text makes a run of its own."""
    out, run, held, first = [], [], 0, 0
    for i, t in enumerate(texts):
        t = t or b""
        if run and held + len(t) > limit:
            out.append((first, run))
            run, held, first = [], 0, i
        run.append(t)
        held += len(t)
    if run:
        out.append((first, run))
    return out


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the operating system, where its allocator can. Spark keeps idle Python workers, whose memory counts as the executor's."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
