"""Distinct items of groups in their order, from rows that Spark has sorted by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values with 0 for NULL, and which are there."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def distinct_in_order(table: pa.Table) -> pa.Table:
    """(group, items) with one row per run of equal groups: its items without those that came before in the run."""
    group, item = (table.column(i).combine_chunks() for i in range(2))
    (g, g_known), (x, x_known) = _numbers(group), _numbers(item)
    starts = np.r_[True, (g[1:] != g[:-1]) | (g_known[1:] != g_known[:-1])]
    run = np.cumsum(starts) - 1
    order = np.lexsort((x, x_known, run))  # stable: of equal items the first one leads
    same = (run[order][1:] == run[order][:-1]) & (x[order][1:] == x[order][:-1]) & (x_known[order][1:] == x_known[order][:-1])
    kept = np.sort(order[np.r_[True, ~same]])
    ends = np.r_[0, np.cumsum(np.bincount(run[kept], minlength=run[-1] + 1))].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), item.take(pa.array(kept)))
    return pa.table([group.take(pa.array(np.flatnonzero(starts))), lists], names=table.column_names)


def distinct_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (group, items) per group, of batches (group, item) sorted by group.

    A group that goes on in the next batch is kept back with its distinct items only, and these are worked through anew
    whenever as many rows have come in as it holds, so a large group takes a few passes over its rows.
    """
    held: list[pa.RecordBatch] = []
    rows, least = 0, 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows < least:
            continue
        found = distinct_in_order(pa.Table.from_batches(held))
        yield from found.slice(0, len(found) - 1).to_batches()
        last = found.slice(len(found) - 1)
        items = pc.list_flatten(last.column(1)).combine_chunks()
        groups = last.column(0).combine_chunks().take(pa.array(np.zeros(len(items), np.int64)))
        held, rows, least = [pa.RecordBatch.from_arrays([groups, items], names=found.column_names)], len(items), 2 * len(items)
    if held:
        yield from distinct_in_order(pa.Table.from_batches(held)).to_batches()
