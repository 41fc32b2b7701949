"""Arrow batches of sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], columns: int = 1) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Consecutive rows of one batch with equal values in the first ``columns``; a run may go on in the next batch."""
    for batch in batches:
        if batch.num_rows:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
            new = np.zeros(batch.num_rows - 1, bool)
            for key in keys:
                new |= (key[1:] != key[:-1]).astype(bool)
            starts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                yield tuple(key[a] for key in keys), batch.slice(a, b - a)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The runs of every value of the first column."""
    held: list[pa.RecordBatch] = []
    current = None
    for key, run in runs(batches):
        if held and key != current:
            yield held
            held = []
        current = key
        held.append(run)
    if held:
        yield held
