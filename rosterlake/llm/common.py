"""Small helpers the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rosterlake.sources.scratch import write_and_read

__all__ = ["read_table", "write_and_read", "utf8_parts", "text_batches", "give_back", "WORD_SPACE"]

#: Bytes that end a word: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD_SPACE = np.zeros(256, bool)
WORD_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


# Arrow's own allocator keeps what it has once had; the system's returns large buffers at once.
pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Hand freed memory back to the system; Python workers outlive their tasks, and so does what they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a C library with that call
        pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    first, n = column.offset, len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, first * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_batches(
    batch: pa.RecordBatch, column: str, max_bytes: int
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch so that no part has much more than ``max_bytes`` of text.

    A single longer text makes a part of its own; texts are never cut.
    """
    _, offsets = utf8_parts(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        part = batch.slice(start, stop - start)
        yield part, *utf8_parts(part.column(column))
        start = stop
