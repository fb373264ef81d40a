"""Deep pages: a listing cut into ranges once, of which a page reads only those that hold its rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import scratch_folder

#: Rows a range is made to hold.
RANGE_ROWS = 1_000_000


def save_ranges(df: DataFrame, folder: str, *keys: Column, ranges: int | None = None) -> None:
    """Write ``df`` in the order of ``keys``, cut into ranges, each row with its place in its range.

    Rows with equal keys get one order, which all pages share. The number of ranges follows
    from the number of rows unless it is given. Columns may have any names, as they travel in one.
    """
    if ranges is None:
        ranges = -(-df.count() // RANGE_ROWS)
    ordered = df.repartitionByRange(max(ranges, 1), *keys).sortWithinPartitions(*keys)
    # The upper bits of the id are the partition, the lower ones count its rows.
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ordered.select(
        F.spark_partition_id().alias("range"), place.alias("place"), F.struct(*df.columns).alias("row")
    ).write.partitionBy("range").parquet(folder)


def read_page(spark: SparkSession, folder: str, schema: StructType, skip: int, limit: int | None) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` of what :func:`save_ranges` wrote, in order.

    ``schema`` is that of the listing. Counting the ranges reads no column, one row per range passes the driver, and
    the ranges the page touches are given to the scan as a literal filter. A task
    keeps rows of the page only. A page beyond the end is empty.
    """
    saved = spark.read.schema(
        StructType().add("range", "integer").add("place", "long").add("row", schema)
    ).parquet(folder)
    counts = saved.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").toLocalIterator()
    wanted, before = F.lit(False), 0
    touched: list[int] = []
    for count in counts:
        first, last = max(skip - before, 0), count.n
        if limit is not None:
            last = min(skip + limit - before, count.n)
        if first < last:
            touched.append(count["range"])
            inner = F.lit(True)
            if (first, last) != (0, count.n):
                inner = F.col("place").between(first, last - 1)
            wanted = wanted | ((F.col("range") == count["range"]) & inner)
        before += count.n
        if limit is not None and before >= skip + limit:
            break
    page = saved.filter(F.col("range").isin(touched)).filter(wanted) if touched else saved.limit(0)
    return page.orderBy("range", "place").select("row.*")


def deep_page(df: DataFrame, skip: int, limit: int | None, *keys: Column, ranges: int | None = None) -> DataFrame:
    """One page of ``df`` by way of ranges in the shared folder; to read many pages, keep the ranges."""
    folder = scratch_folder(df.sparkSession, "ranges")
    save_ranges(df, folder, *keys, ranges=ranges)
    return read_page(df.sparkSession, folder, df.schema, skip, limit)


def page_after(
    df: DataFrame, keys: Sequence[tuple[str, bool]], last: Sequence[Any], limit: int
) -> DataFrame:
    """The ``limit`` rows that follow the row with the key values ``last``.

    ``keys`` are (column, descending); ascending keys have NULL last, descending ones NULL
    first, as all listings do. Nothing before the page is sorted or kept: the condition
    reaches the scan, and a task keeps ``limit`` rows. Keys should tell rows apart: rows equal to ``last`` count as seen.
    """
    follows = F.lit(False)
    for (column, descending), value in reversed(list(zip(keys, last))):
        col = F.col(column)
        if descending:
            beyond = col.isNotNull() if value is None else col < F.lit(value)
        else:
            beyond = F.lit(False) if value is None else (col > F.lit(value)) | col.isNull()
        same = col.isNull() if value is None else col.eqNullSafe(F.lit(value))
        follows = F.coalesce(beyond, F.lit(False)) | (same & follows)
    order = [F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_last() for c, down in keys]
    return df.filter(follows).orderBy(*order).limit(limit)
