"""A minimal acyclic transducer that maps the words of a sorted list to their ordinals."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_ARC = np.dtype([("state", "<u4"), ("byte", "u1"), ("target", "<u4"), ("skip", "<u4")])


class Transducer:
    """States share every common ending; an arc adds the number of words that come before it, so a walk adds up to the ordinal."""

    def __init__(self, arcs: dict[int, int], final: frozenset[int], start: int):
        self.arcs, self.final, self.start = arcs, final, start

    def ordinal(self, word: bytes) -> int:
        """The place of a word in the list, -1 for every other word."""
        state, total, arcs = self.start, 0, self.arcs
        for byte in word:
            arc = arcs.get(state << 8 | byte)
            if arc is None:
                return -1
            state = arc >> 32
            total += arc & 0xFFFFFFFF
        return total if state in self.final else -1

    def pack(self) -> bytes:
        rows = np.zeros(len(self.arcs), _ARC)
        keys, values = (np.fromiter(x, np.int64, len(self.arcs)) for x in (self.arcs.keys(), self.arcs.values()))
        rows["state"], rows["byte"], rows["target"], rows["skip"] = keys >> 8, keys & 255, values >> 32, values & 0xFFFFFFFF
        head = np.array([self.start, len(self.final), *sorted(self.final)], "<u4")
        return head.tobytes() + rows.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Transducer:
        start, n = np.frombuffer(data, "<u4", 2).tolist()
        final = np.frombuffer(data, "<u4", n, 8).tolist()
        rows = np.frombuffer(data, _ARC, offset=8 + 4 * n)
        keys = rows["state"].astype(np.int64) << 8 | rows["byte"]
        values = rows["target"].astype(np.int64) << 32 | rows["skip"]
        return cls(dict(zip(keys.tolist(), values.tolist(), strict=True)), frozenset(final), start)


def build(words: Iterable[bytes]) -> Transducer:
    """The transducer of distinct words in ascending order of their bytes.

    Only the path of the last word is open. What the next word does not share with it is closed from its end upwards:
    a closed state takes the place of an equal one that exists, or becomes a new one.
    """
    known: dict[tuple, int] = {}
    sizes: list[int] = []  # words that a closed state accepts
    arcs: dict[int, int] = {}
    final: set[int] = set()
    path: list[list] = [[False, []]]  # open states: (accepts, [(byte, closed target)])
    last = b""

    def close(state: list) -> int:
        key = (state[0], *state[1])
        number = known.get(key)
        if number is None:
            number = known[key] = len(sizes)
            total = int(state[0])
            for byte, target in state[1]:
                arcs[number << 8 | byte] = target << 32 | total
                total += sizes[target]
            sizes.append(total)
            if state[0]:
                final.add(number)
        return number

    def shrink(length: int) -> None:
        while len(path) > length + 1:
            closed = close(path.pop())
            path[-1][1].append((last[len(path) - 1], closed))

    for word in words:
        shared, most = 0, min(len(word), len(last))
        while shared < most and word[shared] == last[shared]:
            shared += 1
        shrink(shared)
        path.extend([False, []] for _ in range(len(word) - shared))
        path[-1][0] = True
        last = word
    shrink(0)
    start = close(path[0])
    return Transducer(arcs, frozenset(final), start)
