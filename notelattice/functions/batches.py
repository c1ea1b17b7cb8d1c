"""Arrow batches in slices of bounded size: what a Python worker holds beside its batch follows the slice, not the batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def text_sizes(*columns: int) -> Callable[[pa.RecordBatch], np.ndarray]:
    """The bytes that each row has in these string columns."""
    return lambda batch: sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)


def list_sizes(*columns: int) -> Callable[[pa.RecordBatch], np.ndarray]:
    """The values that each row has in these list columns."""
    return lambda batch: sum(pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)


def _release() -> None:
    """Gives freed memory back to the system: Python workers are reused, and would keep each stage's peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], sizes: Callable[[pa.RecordBatch], np.ndarray], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows in their order, in slices whose sizes sum to the limit at most; a row above it is a slice of its own."""
    for batch in batches:
        upto, start = np.cumsum(sizes(batch)), 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch  # before the next one is read
        _release()
