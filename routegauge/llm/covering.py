"""A covering code of 32-bit words as anchor points, and the comparison of fingerprints at an anchor (NumPy).

The code is the direct sum of the binary Golay code (23 bits, covering radius 3), the Hamming code (7 bits, covering
radius 1) and all words of the last 2 bits: 2^18 anchors. Both codes are perfect, so every word has exactly one nearest
codeword in each part.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

GOLAY = (23, 0b101011100011, 3)  # length, generator polynomial, covering radius
HAMMING = (7, 0b1011, 1)
ANCHOR_BITS = 18


def _remainders(length: int, poly: int) -> np.ndarray:
    """Syndrome (remainder by the generator polynomial) of every single bit."""
    degree, out = poly.bit_length() - 1, []
    for i in range(length):
        word = 1 << i
        for j in range(i, degree - 1, -1):
            if word >> j & 1:
                word ^= poly << (j - degree)
        out.append(word)
    return np.array(out, dtype=np.int64)


@cache
def _code(length: int, poly: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(syndrome of each bit, the leader of each syndrome, further errors of weight radius + 1 padded with -1, check bits)."""
    bits = _remainders(length, poly)
    checks = poly.bit_length() - 1
    leader = np.zeros(1 << checks, dtype=np.int64)
    beyond: list[list[int]] = [[] for _ in range(1 << checks)]
    for weight in range(radius + 2):
        for places in combinations(range(length), weight):
            syndrome = int(np.bitwise_xor.reduce(bits[list(places)])) if places else 0
            error = sum(1 << p for p in places)
            if weight <= radius:
                leader[syndrome] = error
            else:
                beyond[syndrome].append(error)
    width = max(map(len, beyond))
    padded = np.array([e + [-1] * (width - len(e)) for e in beyond], dtype=np.int64)
    return bits, leader, padded, checks


def _syndromes(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), dtype=np.int64)
    for i, s in enumerate(bits):
        out ^= np.where(words >> i & 1, s, 0)
    return out


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of 32-bit words: (home anchor of each, further anchors, the row each of those belongs to).

    The home is the nearest anchor. A word one bit away has its home among the home and the further anchors: those
    where one part lies one bit beyond its covering radius.
    """
    golay, hamming, free = halves & 0x7FFFFF, halves >> 23 & 0x7F, halves >> 30 & 3

    def pack(g, h, f):  # information bits identify a codeword
        return (g >> 11) << 6 | (h >> 3) << 2 | f

    g_bits, g_leader, g_beyond, _ = _code(*GOLAY)
    h_bits, h_leader, h_beyond, _ = _code(*HAMMING)
    g_syn, h_syn = _syndromes(golay, g_bits), _syndromes(hamming, h_bits)
    g_home, h_home = golay ^ g_leader[g_syn], hamming ^ h_leader[h_syn]
    home = pack(g_home, h_home, free)
    rows = np.arange(len(halves))
    more, of = [], []
    for errors, build in (
        (g_beyond[g_syn], lambda r, e: pack(golay[r] ^ e, h_home[r], free[r])),
        (h_beyond[h_syn], lambda r, e: pack(g_home[r], hamming[r] ^ e, free[r])),
        (np.tile(np.array([[1, 2]]), (len(halves), 1)), lambda r, e: pack(g_home[r], h_home[r], free[r] ^ e)),
    ):
        r, c = np.nonzero(errors >= 0)
        more.append(build(rows[r], errors[r, c]))
        of.append(rows[r])
    return home, np.concatenate(more), np.concatenate(of)


def hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; ``parent`` ends flat, every entry naming the smallest member."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def forest(key: np.ndarray, value: np.ndarray, home: np.ndarray, most: int, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Compare the visitors of every anchor with its residents; rows are sorted by key, residents first.

    Returns (value, smallest linked value) pairs that span the links of at most ``most`` bits: no more pairs than values.
    """
    nodes, at = np.unique(value, return_inverse=True)
    parent = np.arange(len(nodes))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
    residents = np.bincount(group, weights=home, minlength=len(first)).astype(np.int64)
    todo = residents[group]  # a resident is compared with the residents too: it is its own visitor
    ends = np.cumsum(todo)
    start = 0
    while start < len(key):
        base = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, base + step, "right")), start + 1)
        part = todo[start:stop]
        left = np.repeat(np.arange(start, stop), part)
        offset = np.arange(len(left)) - np.repeat(np.cumsum(part) - part, part)
        right = first[group[left]] + offset
        near = np.bitwise_count(value[left] ^ value[right]) <= most
        hook(parent, at[left[near]], at[right[near]])
        start = stop
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]
