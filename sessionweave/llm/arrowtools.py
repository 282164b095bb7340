"""Helpers for Arrow batch functions."""

from __future__ import annotations

import pyarrow as pa

from ..shipping import ship


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 4_000_000):
    """Slices of a batch with at most about most_bytes of the text column, one row at least."""
    col = batch.column(batch.schema.get_field_index(text))
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype("int64"))
    start = 0
    while start < batch.num_rows:
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def small_batches(spark) -> None:
    """Arrow batches of few rows, as rows can be long texts; and this package on every worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def lean(run):
    """run, giving the memory of its caches and batches back to the system when a task's rows end, as workers are reused."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return inner
