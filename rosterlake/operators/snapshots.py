"""Which parts of two snapshots differ, found from digests instead of from a join of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import write_and_read

#: Keys fall into this many buckets, and those of a bucket into this many pieces.
BUCKETS = PIECES = 1024


def _place(key: str) -> list[Column]:
    spread = F.xxhash64(F.lit("place"), F.col(key))
    return [
        F.pmod(spread, F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.pmod(F.shiftrightunsigned(spread, 32), F.lit(PIECES)).cast("int").alias("piece"),
    ]


def _different(before: DataFrame, after: DataFrame, *by: str) -> DataFrame:
    """Groups whose rows are not the same on both sides, by ``h1`` and ``h2`` of their rows.

    The digest of a group is two XORs of 64 bits, a sum and a count, so rows in any order and repeated
    rows are told apart. Two different groups share one by chance only, about once in 2^128 pairs.
    """

    def digests(rows: DataFrame, side: str) -> DataFrame:
        low = F.col("h2").bitwiseAND(0x7FFFFFFF)
        digest = F.struct(F.bit_xor("h1"), F.bit_xor("h2"), F.sum(low), F.count("*"))
        return rows.groupBy(*by).agg(digest.alias(side))

    paired = digests(before, "was").join(digests(after, "is"), list(by), "full")
    return paired.filter("NOT was <=> is").select(*by)


def differing(
    before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """The rows of both snapshots, ``key`` and ``columns`` of them, from the pieces of the keys in which they differ.

    Every row that changed, came or went is among them, few others are. Both sides are read three
    times, but of all rows only digests are shuffled: a thousand a task for the buckets, then those of the pieces of buckets
    that differ. What differs is written and its size so known to the planner. Columns are of plain types.
    """

    def hashed(rows: DataFrame) -> DataFrame:
        # xxhash64 passes over NULLs, so that they count by themselves.
        parts = [F.col(key), *[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns]]
        return rows.select(
            *_place(key), F.xxhash64(F.lit("h1"), *parts).alias("h1"), F.xxhash64(F.lit("h2"), *parts).alias("h2")
        )

    buckets = write_and_read(_different(hashed(before), hashed(after), "bucket"), "buckets")
    near = [hashed(side).join(buckets, "bucket", "left_semi") for side in (before, after)]
    pieces = write_and_read(_different(*near, "bucket", "piece"), "pieces")

    def within(rows: DataFrame) -> DataFrame:
        placed = rows.select(key, *columns, F.struct(*_place(key)).alias("at"))
        spots = pieces.select(F.struct("bucket", "piece").alias("at"))
        return placed.join(spots, "at", "left_semi").drop("at")

    return within(before), within(after)


def changed_rows(before: DataFrame, after: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows that ``after`` does not have any more and those it has anew; changed rows are in both.

    Columns that only one side has do not count. A NULL key matches nothing, so its rows are in both.
    """
    columns = [c for c in after.columns if c in before.columns and c != key]
    old, new = differing(before, after, key, columns)
    paired = write_and_read(
        old.select(key, F.struct(key, *columns).alias("old"))
        .join(new.select(key, F.struct(key, *columns).alias("new")), key, "full")
        .filter("NOT old <=> new")
        .select("old", "new"),
        "changed",
    )
    return tuple(paired.filter(F.col(side).isNotNull()).select(f"{side}.*") for side in ("old", "new"))
