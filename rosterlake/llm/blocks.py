"""Blocks of documents, and counting hashed features over all of them.

A block holds the texts of some neighbouring rows, packed; it has a number of its own and
is written once, so that later passes can send it answers. ``document_counts`` tells every
block, for each of its distinct features, in how many documents of the whole corpus the
feature stands. A block sends each distinct feature once, so one that stands in every
document costs no more than one entry a block; features are dealt to buckets by hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import give_back, text_batches, write_and_read

#: Text a block holds, and text whose features fill one bucket.
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
#: Counts are kept up to this; more is told as so many.
MOST_COUNTED = 255
#: Stands for a NULL doc_id, which so comes before all others.
NO_ID = np.iinfo(np.int64).min

_SCHEMA = "block long, n_bytes long, ids binary, lengths binary, texts binary, carried binary"

Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _carry(columns: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, columns.schema) as stream:
        stream.write_batch(columns)
    return pack(sink.getvalue().to_pybytes())


def carried(block: dict) -> pa.Table:
    """The further columns of the rows in a block."""
    return pa.ipc.open_stream(unpack(block["carried"])).read_all()


def _fill(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, data, offsets in text_batches(batch, "text", block_bytes):
                ids = part.column("doc_id").fill_null(NO_ID).to_numpy().astype("<i8")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]),
                        pa.array([len(data)]),
                        pa.array([ids.tobytes()]),
                        pa.array([np.diff(offsets).astype("<i8").tobytes()]),
                        pa.array([pack(data.tobytes())]),
                        pa.array([_carry(part.drop_columns(["text", "doc_id"]))], pa.binary()),
                    ],
                    names=["block", "n_bytes", "ids", "lengths", "texts", "carried"],
                )
                number += 1
        give_back()

    return run


def make_blocks(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of ``rows(doc_id, text, …)``, written to the shared folder.

    NULL texts become empty; other columns are carried along as they are.
    """
    typed = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    return write_and_read(typed.mapInArrow(_fill(block_bytes), _SCHEMA), "blocks")


def block_content(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, bytes of all texts, offsets) of a block's row."""
    lengths = np.frombuffer(row["lengths"], "<i8")
    return (
        np.frombuffer(row["ids"], "<i8"),
        np.frombuffer(unpack(row["texts"]), np.uint8),
        np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
    )


def bucket_count(blocks: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets that hold the features of about ``bucket_bytes`` of text each."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return int(max(8, total // bucket_bytes))


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, edges): positions of the keys bucket by bucket, and where each bucket begins."""
    bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


def _send(features: Features, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, data, offsets = block_content(row)
                keys, counts = features(data, offsets)
                order, edges = by_bucket(keys, buckets)
                low = (keys[order] & np.uint64(0xFFFFFFFF)).astype("<u4")
                counts = np.minimum(counts[order], MOST_COUNTED).astype(np.uint8)
                filled = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(filled.astype(np.int32)),
                        pa.array(np.full(len(filled), row["block"], np.int64)),
                        pa.array([low[edges[i] : edges[i + 1]].tobytes() for i in filled], pa.binary()),
                        pa.array([counts[edges[i] : edges[i + 1]].tobytes() for i in filled], pa.binary()),
                    ],
                    names=["bucket", "block", "keys", "counts"],
                )
        give_back()

    return run


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    keys = np.frombuffer(b"".join(rows["keys"]), "<u4")
    counts = np.frombuffer(b"".join(rows["counts"]), np.uint8).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    first = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    total = np.minimum(np.add.reduceat(counts[order], np.flatnonzero(first)), MOST_COUNTED).astype(np.uint8)
    answer = np.empty(len(keys), np.uint8)
    answer[order] = total[np.cumsum(first) - 1]
    edges = np.concatenate([[0], np.cumsum([len(x) // 4 for x in rows["keys"]])])
    told = [pack(answer[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "told": told})


def document_counts(blocks: DataFrame, features: Features, buckets: int) -> DataFrame:
    """(block, bucket, told): how many documents have each feature of the block.

    ``features(data, offsets)`` returns the block's distinct 64-bit hashes, always in the
    same order, and in how many of its documents each stands. Two features of one bucket
    count as one if 32 further bits of their hashes are equal, which can only raise a
    count: use the counts to leave out what stands alone, not to find what is equal.
    """
    sent = blocks.mapInArrow(_send(features, buckets), "bucket int, block long, keys binary, counts binary")
    return sent.groupBy("bucket").applyInPandas(_count, "block long, bucket int, told binary")


def counts_told(keys: np.ndarray, told: pd.DataFrame, buckets: int) -> np.ndarray:
    """The answers for one block's features, in the features' order."""
    order, _ = by_bucket(keys, buckets)
    answer = np.empty(len(keys), np.uint8)
    told = told.sort_values("bucket")
    answer[order] = np.frombuffer(b"".join(map(unpack, told["told"])), np.uint8)
    return answer
