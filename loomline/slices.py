"""Arrow batches in parts of bounded size: Spark hands over up to 10,000 rows or 64 MB at once."""
from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once inside a task, whatever the size of the Arrow batch.
SLICE_BYTES = 2 << 20


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows whose text is about ``limit`` bytes (one long text is a run of its own)."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(size) - size) // limit
    cuts = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n]):
        yield batch.slice(a, b - a)
    trim()


def trim() -> None:
    """Give unused memory back: Python workers live on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)
