"""Substring dedup by line hashing.

A unit is a line. It is normalised (lower case, runs of white space to one blank, trimmed),
and units that say the same are grouped by digest over the whole corpus. The earliest
occurrence in (doc_id, unit number) order stays; every other one is removed together with
its line break, and its place in the original text is retained.

Digests are reduced to their earliest occurrence per task before they are shuffled, so a
line that stands in a third of all documents costs one row a task. Only digests seen more
than once are joined back, and a text meets nothing but its own list of removed units.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.common import read_table, write_and_read

_BLANKS = re.compile(r"[ \t\v\f\r]+")


def normalise(line: str) -> str:
    return _BLANKS.sub(" ", line).strip(" ").lower()


def _digests(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, marks, units, digests = [], [], [], []
                for key, mark, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for unit, line in enumerate((text or "").split("\n")):
                        said = normalise(line)
                        if len(said) >= min_chars:
                            keys.append(key)
                            marks.append(mark)
                            units.append(unit)
                            digests.append(hashlib.md5(said.encode()).digest())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(marks, pa.int64()), pa.array(units, pa.int32()), pa.array(digests, pa.binary())],
                    names=["doc_id", "mark", "unit", "digest"],
                )

    return run


def _cut(text: str, removed: list[int]) -> tuple[str, list[dict]]:
    """The text without some of its lines, and the bytes [start, end) of each run of them."""
    lines = text.split("\n")
    sizes = np.array([len(x.encode()) for x in lines])
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    gone = np.zeros(len(lines) + 2, np.int8)
    gone[np.array(removed) + 1] = 1
    edges = np.diff(gone)
    spans = [
        {"start": int(starts[a]), "end": int(starts[b] + sizes[b])}
        for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1, strict=True)
    ]
    return "\n".join(x for x, out in zip(lines, gone[1:], strict=False) if not out), spans


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            kept, spans = [], []
            texts, removed = part.column("text").to_pylist(), part.column("removed").to_pylist()
            for text, out in zip(texts, removed, strict=True):
                text, found = _cut(text, out) if out else (text or "", [])
                kept.append(text)
                spans.append(found)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                    pa.array([(t or "").count("\n") + 1 for t in texts], pa.int64()),
                    pa.array([len(out or []) for out in removed], pa.int64()),
                    pa.array(kept, pa.string()),
                    pa.array(spans, spans_type),
                ],
                names=["doc_id", "n_bytes", "n_units", "n_removed_units", "kept", "spans"],
            )


def remove_repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 1
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_units, n_removed_units, kept, spans.

    ``kept`` is the text without its removed lines; ``spans`` are the bytes [start, end)
    of the original that each run of removed lines covers, without the last line break.

    Every unit that is not empty after normalising counts; ``min_chars`` lets shorter ones stay.
    A NULL or empty text is one empty unit and stays as ''. Within a text the first of equal
    lines stays. Rows that share a doc_id are ranked by a hash of their text; rows that
    are equal in both count as one document and get the same result. A NULL doc_id ranks
    first. Texts of any length are read whole; other columns are ignored.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text)).alias("mark"),
        F.col(text).alias("text"),
    )
    units = write_and_read(
        rows.mapInArrow(_digests(min_chars), "doc_id long, mark long, unit int, digest binary"), "units"
    )
    first = (
        units.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "mark", "unit")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "first")
    )
    repeated = units.join(write_and_read(first, "first_units"), "digest")
    same = (
        F.col("first.doc_id").eqNullSafe(F.col("doc_id"))
        & F.col("first.mark").eqNullSafe(F.col("mark"))
        & (F.col("first.unit") == F.col("unit"))
    )
    removed = (
        repeated.filter(~same)
        .groupBy("doc_id", "mark")
        .agg(F.sort_array(F.collect_set("unit")).alias("removed"))
        .select(F.col("doc_id").alias("k"), F.col("mark").alias("m"), "removed")
    )
    joined = rows.join(
        removed, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("mark") == F.col("m")), "left"
    )
    return joined.select("doc_id", "text", "removed").mapInArrow(
        _remove,
        "doc_id long, n_bytes long, n_units long, n_removed_units long, kept string,"
        " spans array<struct<start:long,end:long>>",
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = remove_repeated_lines(read_table(spark, sf_dir, "documents"))
    return result.select(
        "doc_id",
        "n_bytes",
        "n_units",
        "n_removed_units",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLE = """
WITH units AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS unit
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), said AS (
  SELECT *, lower(trim(regexp_replace(line, '[ \\t\\v\\f\\r]+', ' ', 'g'), ' ')) AS norm FROM units
), ranked AS (
  SELECT *, norm <> ''
      AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, unit) > 1 AS gone
  FROM said
), runs AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY unit), false) AS begins
  FROM ranked
), per_doc AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed_units,
         count(*) FILTER (begins) AS n_spans,
         coalesce(string_agg(line, chr(10) ORDER BY unit) FILTER (NOT gone), '') AS kept
  FROM runs GROUP BY doc_id
)
SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, n_units::BIGINT AS n_units,
       n_removed_units::BIGINT AS n_removed_units,
       (strlen(coalesce(text, '')) - strlen(kept))::BIGINT AS n_removed,
       n_spans::BIGINT AS n_spans, sha256(kept) AS kept_sha256
FROM documents JOIN per_doc USING (doc_id)
"""
