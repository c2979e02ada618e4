"""Segments of lines, the substrings that may match them, and a banded bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix


def segments(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of ``most + 1`` segments of nearly equal length."""
    base, longer = divmod(length, most + 1)
    out, at = [], 0
    for i in range(most + 1):
        size = base + (i >= most + 1 - longer)
        out.append((at, size))
        at += size
    return out


def probes(length: int, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(indexed length, segment, start, size) of the substrings of a line to look up among lines no longer than it.

    Of ``most`` edits, segment i has i left of it at most while it is intact, or ``most - i`` right of it; a start that
    neither side allows need not be looked up.
    """
    for other in range(max(length - most, most + 1), length + 1):
        shift = length - other
        for i, (at, size) in enumerate(segments(other, most)):
            low = max(at - i, at + shift - (most - i), 0)
            high = min(at + i, at + shift + (most - i), length - size)
            for start in range(low, high + 1):
                yield other, i, start, size


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``.

    Of every row only the 2 * most + 1 cells around the diagonal are kept, as bits: one word per number of edits, whose bit
    d says that the cell on diagonal d - most is reached with so many edits.
    """
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    head = len(commonprefix((a, b)))
    a, b = a[head:], b[head:]
    tail = len(commonprefix((a[::-1], b[::-1])))
    if tail:
        a, b = a[:-tail], b[:-tail]
    if not a or not b:
        return len(a) + len(b) <= most
    places: dict[str, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << (j + most)
    band = (1 << (2 * most + 1)) - 1
    rows = [1 << most]
    for _ in range(most):
        rows.append((rows[-1] | rows[-1] << 1) & band)
    for i, c in enumerate(a):
        same = places.get(c, 0) >> i & band
        nxt = [rows[0] & same]
        for e in range(1, most + 1):
            nxt.append((rows[e] & same | rows[e - 1] | rows[e - 1] >> 1 | nxt[e - 1] << 1) & band)
        rows = nxt
        if not rows[most]:
            return False
    return bool(rows[most] >> (len(b) - len(a) + most) & 1)
