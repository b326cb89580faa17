"""Arrow batches in slices of bounded text, so that what a task holds doesn't grow with its batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a worker works on at once.
MOST_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, *columns: int, most: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices whose texts in ``columns`` have ``most`` bytes at most; a longer row is a slice of its own."""
    size = sum((pc.binary_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns), np.zeros(batch.num_rows, np.int64))
    ends, a = np.cumsum(size), 0
    while a < batch.num_rows:
        before = ends[a - 1] if a else 0
        z = max(a + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(a, z - a)
        a = z
