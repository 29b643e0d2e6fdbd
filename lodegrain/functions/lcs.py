"""A longest common subsequence of two lists, in memory that grows with their lengths and not with their product.

Rows of the length table are bits of one integer, so a row is a few operations on machine words. Small tables are kept whole and walked back; larger ones are split in the
middle of the second list, where the first is split best, and each half is done alone.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence

import numpy as np

#: Bits of a table that is kept whole.
TABLE_BITS = 1 << 25


def _rows(a: Sequence[Hashable], b: Sequence[Hashable]) -> Iterator[int]:
    """For each beginning of b the table's row: bit i is 0 where a[: i + 1] has a longer common subsequence with it than a[:i]."""
    places: dict[Hashable, int] = {}
    wanted = set(b)
    for i, x in enumerate(a):
        if x in wanted:
            places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit | row - hit) & full
        yield row


def _lengths(a: Sequence[Hashable], b: Sequence[Hashable]) -> np.ndarray:
    """The length for each beginning of a with all of b."""
    row = (1 << len(a)) - 1
    for row in _rows(a, b):  # noqa: B007  only the last counts
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _pairs(a: Sequence[Hashable], b: Sequence[Hashable], at_a: int, at_b: int, out: list[tuple[int, int]]) -> None:
    if not a or not b:
        return
    if len(b) == 1:
        if b[0] in a:
            out.append((at_a + list(a).index(b[0]), at_b))
        return
    if len(a) * len(b) > TABLE_BITS:
        middle = len(b) // 2
        cut = int((_lengths(a, b[:middle]) + _lengths(a[::-1], b[middle:][::-1])[::-1]).argmax())
        _pairs(a[:cut], b[:middle], at_a, at_b, out)
        _pairs(a[cut:], b[middle:], at_a + cut, at_b + middle, out)
        return
    size = len(a) // 8 + 1
    table = [r.to_bytes(size, "little") for r in _rows(a, b)]
    longer = lambda i, j: not table[j - 1][(i - 1) >> 3] >> ((i - 1) & 7) & 1
    i, j, found = len(a), len(b), []
    while i and j:
        if not longer(i, j):
            i -= 1
        elif j > 1 and longer(i, j - 1):
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((at_a + i, at_b + j))
    out += reversed(found)


def common(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence, ascending. Equal beginnings and ends are matched as they are."""
    first, most = 0, min(len(a), len(b))
    while first < most and a[first] == b[first]:
        first += 1
    last = 0
    while last < most - first and a[-1 - last] == b[-1 - last]:
        last += 1
    out = [(i, i) for i in range(first)]
    # elements of one side only match nothing
    in_b, in_a = set(b[first : len(b) - last]), set(a[first : len(a) - last])
    of_a = [i for i in range(first, len(a) - last) if a[i] in in_b]
    of_b = [j for j in range(first, len(b) - last) if b[j] in in_a]
    inner: list[tuple[int, int]] = []
    _pairs([a[i] for i in of_a], [b[j] for j in of_b], 0, 0, inner)
    out += [(of_a[i], of_b[j]) for i, j in inner]
    return out + [(len(a) - k, len(b) - k) for k in range(last, 0, -1)]
