"""Small helpers shared by the operators: reading, hold-out split, batch slicing."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.session import data_path

# Bytes of text handled at once by the vectorised kernels. Their work arrays
# take about 40 bytes for each byte of text. A single longer text is a slice of its own:
# a worker needs about 40 times the bytes of the longest text (2 GB for 50 MB).
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(data_path(sf_dir, name))


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents on which nothing is learned; false
    for a null id, from which nothing is learned either (see ``trainable``)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trainable(doc_id: Column) -> Column:
    return doc_id.isNotNull() & ~held_out(doc_id)


def as_binary(column) -> pa.LargeBinaryArray:
    """UTF-8 bytes of an Arrow text column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    return pc.fill_null(column, b"") if column.null_count else column


def slices(column: pa.LargeBinaryArray, limit: int = SLICE_BYTES):
    """Yield ``(first_row, bytes, offsets)`` for runs of rows of at most
    ``limit`` bytes (a longer single row is a run of its own)."""
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def give_back() -> None:
    """Return freed memory to the system: workers stay idle between their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
