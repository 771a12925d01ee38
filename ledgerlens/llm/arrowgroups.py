"""Whole key groups from Arrow batches that are sorted by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole key groups, from batches sorted by ``keys``; small groups come many together."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for key in keys:
            x = batch.column(key).to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
            change[0] |= not held or held[-1].column(key)[-1].as_py() != x[0]
        at = np.flatnonzero(change)
        if len(at):
            if at[-1] > 0:
                held.append(batch.slice(0, at[-1]))
            if held:
                yield pa.Table.from_batches(held)
            held, rows = [batch.slice(at[-1])], batch.num_rows - at[-1]
        else:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def group_heads(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for key in keys:
        x = table.column(key).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)
