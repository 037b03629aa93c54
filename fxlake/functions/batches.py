"""Groups of sorted rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changes(ids: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are equal."""
    a, b = ids.slice(1), ids.slice(0, max(0, len(ids) - 1))
    differ = pc.coalesce(pc.not_equal(a, b), pc.xor(a.is_null(), b.is_null()))
    return np.asarray(differ.to_numpy() if isinstance(differ, pa.ChunkedArray) else differ.to_numpy(zero_copy_only=False), bool)


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that lie together: a batch's, less the last group, which may go on in the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1][k][-1] != batch[k][0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        ends = np.flatnonzero(np.logical_or.reduce([changes(batch[k]) for k in keys])) + 1
        if len(ends):
            yield pa.Table.from_batches([*held, batch.slice(0, int(ends[-1]))])
            held, batch = [], batch.slice(int(ends[-1]))
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
