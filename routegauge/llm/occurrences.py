"""T-occurrence search over inverted lists by DivideSkip, and the linking of sets within one block."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from fractions import Fraction
from heapq import heapify, heappop, heappush
from math import log2

_WEIGHT = 0.01  # how much the length of the longest list shifts the border between short and long lists


class Occurrences:
    """Inverted lists of sets; numbers are added in ascending order, so every list is sorted."""

    def __init__(self):
        self.lists: dict[int, list[int]] = {}

    def add(self, number: int, values) -> None:
        lists = self.lists
        for v in values:
            if (found := lists.get(v)) is None:
                lists[v] = [number]
            elif found[-1] != number:
                found.append(number)

    def search(self, values, least: int, skip: Callable[[int], bool] = lambda number: False) -> Iterator[tuple[int, int]]:
        """(number, occurrences) of every number in at least ``least`` lists of these values, but those to ``skip``.

        The longest lists are set aside. The short ones are merged on a heap; whatever cannot occur often enough there is
        jumped over, and what does is looked up in the long ones by binary search.
        """
        get = self.lists.get
        lists = sorted((found for v in values if (found := get(v)) is not None), key=len)
        if least < 1 or len(lists) < least:
            return
        aside = min(int(least / (_WEIGHT * log2(len(lists[-1])) + 1)), least - 1)
        short, far = lists[: len(lists) - aside], lists[len(lists) - aside :]
        wanted = least - aside
        heap = [(found[0], j, 0) for j, found in enumerate(short)]
        heapify(heap)
        while len(heap) >= wanted:
            top, popped = heap[0][0], []
            while heap and heap[0][0] == top:
                popped.append(heappop(heap))
            if len(popped) >= wanted:
                count, left = (0, 0) if skip(top) else (len(popped), aside)
                for found in far:
                    if count + left < least:
                        break
                    left -= 1
                    at = bisect_left(found, top)
                    count += at < len(found) and found[at] == top
                if count >= least:
                    yield top, count
                for _, j, at in popped:
                    if at + 1 < len(short[j]):
                        heappush(heap, (short[j][at + 1], j, at + 1))
                continue
            while heap and len(popped) < wanted - 1:
                popped.append(heappop(heap))
            if not heap:
                return
            target = heap[0][0]
            for _, j, at in popped:
                at = bisect_left(short[j], target, at)
                if at < len(short[j]):
                    heappush(heap, (short[j][at], j, at))


class Forest:
    """Sets that are linked already, by union and find."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


class _Cell:
    """A first set and those linked to it one by one; all are of one component."""

    def __init__(self, node: int, values: set[int]):
        self.nodes, self.sizes, self.first, self.members = [node], [len(values)], values, None

    def add(self, node: int, values: set[int]) -> None:
        if self.members is None:
            self.members = Occurrences()
        self.members.add(len(self.nodes), values)
        self.nodes.append(node)
        self.sizes.append(len(values))


class Linker:
    """Finds links between sets of similarity ``least`` or more until nothing unlinked can be linked.

    Residents are kept in cells. The inverted lists over cells hold a value once per cell, however many members have it: a
    cell that does not reach the overlap has no member that does. In a cell that reaches it, the first set is compared, then
    the lists of its members are searched, up to the first link. Cells of the component that a set has joined are passed over.
    """

    def __init__(self, least: Fraction, forest: Forest):
        self.least, self.forest = least, forest
        self.cells: list[_Cell] = []
        self.over = Occurrences()

    def _alike(self, both: int, one: int, two: int) -> bool:
        return both * self.least.denominator >= (one + two - both) * self.least.numerator

    def _reached(self, cell: _Cell, count: int, values: set[int], least: int) -> int | None:
        """The place in the cell of a set linked to these values."""
        both = count if cell.members is None else len(values & cell.first)
        if self._alike(both, len(values), cell.sizes[0]):
            return 0
        if cell.members is not None:
            for place, both in cell.members.search(values, least):
                if self._alike(both, len(values), cell.sizes[place]):
                    return place
        return None

    def visit(self, node: int, values: set[int], stays: bool) -> list[tuple[int, int]]:
        """Links of a set to residents, one for every component that it joins; with ``stays`` it becomes a resident."""
        least = -(-len(values) * self.least.numerator // self.least.denominator)
        links, home, root = [], None, self.forest.root

        def joined(number: int) -> bool:
            return root(self.cells[number].nodes[0]) == root(node)

        for number, count in self.over.search(values, least, joined):
            cell = self.cells[number]
            if (place := self._reached(cell, count, values, least)) is not None:
                links.append((node, cell.nodes[place]))
                self.forest.join(node, cell.nodes[place])
                home = number if home is None else home
        if stays:
            if home is None:
                home = len(self.cells)
                self.cells.append(_Cell(node, values))
            else:
                self.cells[home].add(node, values)
            self.late(home, values)
        return links

    def late(self, number: int, values: set[int]) -> None:
        """Enter values of a cell into the lists over cells, which must stay sorted."""
        lists = self.over.lists
        for v in values:
            found = lists.get(v)
            if found is None:
                lists[v] = [number]
            elif found[-1] < number:
                found.append(number)
            else:
                at = bisect_left(found, number)
                if found[at] != number:
                    found.insert(at, number)
