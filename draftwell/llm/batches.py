"""Arrow batches cut to a bounded number of text bytes, so that long texts do not pile up in a worker."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at least one row and, beyond that, at most ``most`` bytes in the binary or string ``column``."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)], dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
