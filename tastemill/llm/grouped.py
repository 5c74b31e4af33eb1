"""Sorted rows of a partition, group by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows in batches that end where a group ends, and where the groups begin and the last ends.

    Groups are runs of equal values in the first ``n_keys`` columns, which hold no nulls. One group and one batch are held.
    """
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> tuple[pa.RecordBatch, np.ndarray, list[pa.RecordBatch]]:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in range(n_keys):
            key = batch.column(c).to_numpy(zero_copy_only=False)
            change |= key[1:] != key[:-1]
        begins = np.concatenate([[0], np.flatnonzero(change) + 1])
        if last:
            return batch, np.append(begins, batch.num_rows), []
        return batch.slice(0, begins[-1]), begins, [batch.slice(begins[-1])]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        whole, begins, rest = cut(False)
        if whole.num_rows:
            yield whole, begins
            held = rest
    if held:
        whole, begins, _ = cut(True)
        yield whole, begins
    held.clear()
    pa.default_memory_pool().release_unused()  # see textbytes.pieces
