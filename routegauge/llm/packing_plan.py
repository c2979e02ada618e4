"""Bin packing over a histogram of lengths: the linear grouping scheme, then best fit.

Everything here works on counts per length, of which there are at most ``capacity``; the number of items plays no part.
Items of one length are told apart by their rank (0, 1, ...), sequences by consecutive numbers, and the plan is a list of
runs: ``count`` items of ``length`` from rank ``rank`` on go to as many sequences from ``sequence`` on, at ``offset``.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np

GROUPS = 32
LARGE = (2, 3, 4)  # lengths above capacity / part are large; the part that needs the fewest sequences is taken


@dataclass
class Plan:
    capacity: int
    sequences: int = 0
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, rank, sequence, count, offset


def grouped(histogram: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Items in falling length, cut into groups of equal cardinality: (largest length, runs of [length, rank, count])."""
    size = -(-sum(histogram.values()) // groups) if histogram else 0
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if not room:
                if out and out[-1][0] == length:  # a group of the same rounded length: one demand
                    room = size
                else:
                    out.append((length, []))
                    room = size
            take = min(room, left)
            out[-1][1].append([length, rank, take])
            rank, left, room = rank + take, left - take, room - take
    return out


def _best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of sizes within the capacity with the highest price."""
    worth, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        worth[c], pick[c] = worth[c - 1], -1
        fits = np.flatnonzero(sizes <= c)
        value = worth[c - sizes[fits]] + prices[fits]
        best = int(value.argmax())
        if value[best] > worth[c] + 1e-12:
            worth[c], pick[c] = value[best], fits[best]
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(worth[capacity]), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns of few sizes with whole multiplicities: the configuration program by column generation, rounded down."""
    s, d = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // s).astype(float))
    for _ in range(200 * len(sizes)):  # ends at the optimum; a stop before it would still leave a feasible basis
        value, pattern = _best_pattern(s, np.linalg.solve(basis.T, np.ones(len(s))), capacity)
        if value <= 1 + 1e-9:
            break
        x, step = np.linalg.solve(basis, d), np.linalg.solve(basis, pattern)
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    counts = np.floor(np.linalg.solve(basis, d) + 1e-6).astype(int)
    return [(basis[:, j], int(n)) for j, n in enumerate(counts) if n > 0]


def make_plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS, parts: tuple[int, ...] = LARGE) -> Plan:
    """Pack all items of a histogram (lengths from 1 to ``capacity``) into as few sequences as any bound in ``parts`` gives."""
    return min((_plan(histogram, capacity, groups, part) for part in parts), key=lambda p: p.sequences)


def _plan(histogram: dict[int, int], capacity: int, groups: int, part: int) -> Plan:
    plan = Plan(capacity)
    if full := histogram.get(capacity, 0):
        plan.runs.append((capacity, 0, 0, full, 0))
        plan.sequences = full
    large = {n: c for n, c in histogram.items() if capacity // part < n < capacity}
    rest: dict[int, list[list[int]]] = {n: [[n, 0, c]] for n, c in histogram.items() if n <= capacity // part}
    gaps: dict[int, list[list[int]]] = {}  # room left: [first sequence, sequences]
    pools = grouped(large, groups)
    if pools:
        chosen = configurations([n for n, _ in pools], [sum(r[2] for r in runs) for _, runs in pools], capacity)
        for pattern, many in chosen:
            spans = [[plan.sequences, many, 0]]  # sequence, count, used
            plan.sequences += many
            for g in np.repeat(np.arange(len(pools)), pattern.astype(int)):
                spans = _fill(plan, spans, pools[g][1])
            for first, count, used in spans:
                gaps.setdefault(capacity - used, []).append([first, count])
        for _, runs in pools:
            for length, rank, count in runs:
                if count:
                    rest.setdefault(length, []).append([length, rank, count])
    _best_fit(plan, rest, gaps)
    return plan


def _fill(plan: Plan, spans: list[list[int]], pool: list[list[int]]) -> list[list[int]]:
    """Give each sequence of the spans the next item of the pool; spans are cut where the length changes."""
    out = []
    for first, count, used in spans:
        while count and pool:
            length, rank, left = pool[0]
            take = min(count, left)
            plan.runs.append((length, rank, first, take, used))
            out.append([first, take, used + length])
            first, count = first + take, count - take
            if left == take:
                pool.pop(0)
            else:
                pool[0] = [length, rank + take, left - take]
        if count:  # the pool of this group is used up: the slot stays empty
            out.append([first, count, used])
    return out


def _best_fit(plan: Plan, rest: dict[int, list[list[int]]], gaps: dict[int, list[list[int]]]) -> None:
    """Place items in falling length, each into the smallest room that takes it, or into a new sequence."""
    rooms = sorted(r for r in gaps if r)
    for length in sorted(rest, reverse=True):
        for _, rank, count in rest[length]:
            while count:
                at = bisect_left(rooms, length)
                if at == len(rooms):
                    new = -(-count // (plan.capacity // length))
                    gaps.setdefault(plan.capacity, []).append([plan.sequences, new])
                    plan.sequences += new
                    insort(rooms, plan.capacity)
                    continue
                room = rooms[at]
                first, many = gaps[room].pop()
                take = min(many, count)
                if take < many:
                    gaps[room].append([first + take, many - take])
                if not gaps[room]:
                    rooms.pop(at)
                plan.runs.append((length, rank, first, take, plan.capacity - room))
                left = room - length
                if left:
                    if not gaps.get(left):
                        insort(rooms, left)
                    gaps.setdefault(left, []).append([first, take])
                rank, count = rank + take, count - take
