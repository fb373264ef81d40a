"""Records of CSV files whose quoted fields may hold line breaks, read in splits.

Where a split starts, nobody knows yet whether its first line lies within quotes. Every line
therefore is marked for both cases: does it start within quotes, and the how manieth record of the
split does it belong to. A split as a whole then is a step from "within quotes or not" at its start to the
same at its end; following these steps through a file, one small row per split, tells which case holds.
Records of one line go on from where they were read, only the lines of longer ones are put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import write_and_read

SPLIT = ["file", "block", "length"]
OPTIONS = {"escape": '"', "multiLine": "true"}

# Whole fields, each with its comma, and then one whose quotes do not close. A quote opens
# a field only as its first character; what follows the closing quote belongs to the field.
_QUOTED = r'"[^"]*(?:""[^"]*)*'
_PLAIN = r'(?:[^",][^,]*)?'
OPEN_END = rf'\A(?:(?:{_QUOTED}"{_PLAIN}|{_PLAIN}),)*{_QUOTED}\z'


def open_ends(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether a quoted field is open after each line, if none was open before it, and if one was."""
    outside = np.zeros(len(lines), bool)
    within = ~outside
    quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    some = lines.take(pa.array(quoted))
    outside[quoted] = pc.match_substring_regex(some, OPEN_END).to_numpy(zero_copy_only=False)
    some = pc.binary_join_element_wise('"', some, "")
    within[quoted] = pc.match_substring_regex(some, OPEN_END).to_numpy(zero_copy_only=False)
    return outside, within


class _Split:
    """What is known of a split after some of its lines, for both cases."""

    def __init__(self) -> None:
        self.place, self.within, self.records = 0, [False, True], [0, 0]

    def read(self, outside: np.ndarray, within: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, starts, ends, record) of the next lines, the last three with a row per case.

        A line that ends the same in both cases settles what follows; one that turns both round flips it.
        """
        n = len(blank)
        places = np.arange(self.place, self.place + n)
        self.place += n
        at = np.arange(n)
        settled = np.maximum.accumulate(np.where(outside == within, at, -1))
        turns = np.cumsum(outside & ~within)
        since = turns - np.where(settled >= 0, turns[settled], 0)
        starts, ends, counts = np.empty((2, n), bool), np.empty((2, n), bool), np.empty((2, n), np.int64)
        for case in (0, 1):
            base = np.where(settled >= 0, outside[settled], self.within[case])
            ends[case] = base ^ (since % 2 == 1)
            starts[case, 0], starts[case, 1:] = self.within[case], ends[case, :-1]
            counts[case] = self.records[case] + np.cumsum(~starts[case] & ~blank)
            self.within[case], self.records[case] = bool(ends[case, -1]), int(counts[case, -1])
        return places, starts, ends, counts


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Batches cut where a split ends: (split, is it a new one, lines)."""
    previous = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        changes = np.zeros(n, bool)
        for name in SPLIT:
            column = batch.column(name)
            changes[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        edges = [0, *np.flatnonzero(changes).tolist(), n]
        for low, high in zip(edges, edges[1:]):
            split = tuple(batch.column(name)[low].as_py() for name in SPLIT)
            yield split, split != previous, batch.slice(low, high - low)
            previous = split


def _blank(lines: pa.Array) -> np.ndarray:
    return pc.is_in(lines, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to lines, split by split and in order, what holds if the split starts outside or within quotes."""
    state = _Split()
    for _, new, part in _parts(batches):
        if new:
            state = _Split()
        lines = part.column("value")
        places, *marks = state.read(*open_ends(lines), _blank(lines))
        yield pa.RecordBatch.from_arrays(
            [lines, *[part.column(n) for n in SPLIT], pa.array(places), *[pa.array(m[c]) for m in marks for c in (0, 1)]],
            names=["value", *SPLIT, "place", "starts0", "starts1", "ends0", "ends1", "record0", "record1"],
        )


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: what holds at its end, and whether its first line ends with a carriage return."""
    state, last, crlf = _Split(), None, False

    def row() -> pa.RecordBatch:
        values = [*last, *state.within, *state.records, crlf]
        names = [*SPLIT, "ends0", "ends1", "record0", "record1", "crlf"]
        return pa.RecordBatch.from_pylist([dict(zip(names, values, strict=True))])

    for split, new, part in _parts(batches):
        lines = part.column("value")
        if new:
            if last:
                yield row()
            state, last, crlf = _Split(), split, lines[0].as_py().endswith("\r")
        state.read(*open_ends(lines), _blank(lines))
    if last:
        yield row()


_TOTAL = (
    "file string, block long, length long, ends0 boolean, ends1 boolean, record0 long, record1 long, crlf boolean"
)
_MARKED = (
    "value string, file string, block long, length long, place long, starts0 boolean, starts1 boolean,"
    " ends0 boolean, ends1 boolean, record0 long, record1 long"
)


def _splits(totals: DataFrame) -> DataFrame:
    """One row per split: ``within`` quotes at its start or not, records before it, header in it or not.

    A split either passes on what it starts with, turns it round, or ends the same in both
    cases. What holds after it follows from the last one that ends the same and from how many
    turned it round since.
    """
    ordered = Window.partitionBy("file").orderBy("block")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    settled = F.col("ends0") == F.col("ends1")
    turned = (F.col("turns") - F.coalesce("turns_settled", F.lit(0))) % 2 == 1
    return (
        totals.withColumn("crlf", F.col("crlf") & (F.col("block") == 0))
        .withColumn("crlf", F.max("crlf").over(Window.partitionBy("file")))
        .withColumn("turns", F.sum((F.col("ends0") & ~F.col("ends1")).cast("int")).over(so_far))
        .withColumn("turns_settled", F.last(F.when(settled, F.col("turns")), ignorenulls=True).over(so_far))
        .withColumn("settled", F.last(F.when(settled, F.col("ends0")), ignorenulls=True).over(so_far))
        .withColumn("after", F.coalesce("settled", F.lit(False)) != turned)
        .withColumn("within", F.lag("after", 1, False).over(ordered))
        .withColumn("n", F.when(F.col("within"), F.col("record1")).otherwise(F.col("record0")))
        .withColumn("in_file", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("header", ((F.col("in_file") == 0) & (F.col("n") > 0)).cast("long"))
        .withColumn("offset", F.coalesce(F.sum(F.col("n") - F.col("header")).over(earlier), F.lit(0)))
        .select(*SPLIT, "within", "in_file", "header", "offset", "crlf")
    )


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of the CSV files below ``path``: ``row_no`` in file order, from 1, and ``fields``, all text.

    Gives the rows of Spark's ``multiLine`` reader with a header and ``""`` for a quote within quotes,
    but a large file is read by as many tasks as it has splits. Lines end with ``\\n`` or ``\\r\\n``, and
    where a file's first one ends with the latter, those within quotes become ``\\n``;
    blank lines between records are no records; every file starts with a header, the first one's
    names the columns; records may be shorter or longer than it. A file without records gives none. A
    quote that is never closed makes what follows in its file one record.
    """
    names = spark.read.options(header=True, **OPTIONS).csv(path).columns
    lines = spark.read.text(path, lineSep="\n").select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("length"),
    )
    totals = lines.mapInArrow(_total, _TOTAL)
    # Written, so that the planner sees how small it is and leaves the lines where they are.
    splits = write_and_read(_splits(totals), "splits")

    def case(name: str) -> Column:
        return F.when(F.col("within"), F.col(f"{name}1")).otherwise(F.col(f"{name}0")).alias(name)

    placed = lines.mapInArrow(_mark, _MARKED).join(splits, SPLIT, "left").select(
        "value", "block", "place", case("starts"), case("ends"), case("record"), "in_file", "header", "crlf",
        # Files that changed, or were split otherwise, since the splits were counted.
        F.coalesce("offset", F.raise_error(F.lit(f"files in {path} changed while they were read"))).alias("offset"),
    )
    kept = placed.filter("(starts OR value NOT IN ('', '\\r')) AND in_file + record > 1").select(
        (F.col("offset") + F.col("record") - F.col("header")).alias("row_no"), "value", "crlf", "block", "place", "starts", "ends"
    )
    one_line = kept.filter("NOT starts AND NOT ends").select("row_no", "value")
    pieces = kept.filter("starts OR ends").groupBy("row_no").agg(
        F.max("crlf").alias("crlf"),
        F.array_sort(F.collect_list(F.struct("block", "place", "value"))).alias("pieces"),
    )
    joined = F.array_join(F.col("pieces.value"), "\n")
    ended = F.when(F.col("crlf"), F.replace(joined, F.lit("\r\n"), F.lit("\n"))).otherwise(joined)
    longer = pieces.select("row_no", ended.alias("value"))
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    fields = F.from_csv(F.regexp_replace("value", r"\r\z", ""), schema, OPTIONS)
    return one_line.unionByName(longer).select("row_no", fields.alias("fields"))
