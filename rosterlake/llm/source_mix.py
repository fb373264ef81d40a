"""Mixing sources to target weights by cube-method balanced sampling.

A source whose target is r times its size takes every document floor(r) times, and each
once more with probability r - floor(r). Which ones is drawn by the cube method: the
probabilities of a few documents at a time move along the null space of the balancing
constraints (words and documents taken), so both totals stay as they are while one
probability after the other becomes 0 or 1. At most two per block stay open; these meet in
blocks of their own, round after round, until one block a source is left, whose last two
are rounded to the nearest total, and the gap that leaves is filled ("landing"). Blocks go by a hash of doc_id, text and
(of equal rows) a number, and hold some thousand rows, so a source or a doc_id with most of the rows is
spread over as many tasks as it needs.
Within a block long documents are settled first, so that the open ones are short.
"""

from __future__ import annotations

import hashlib
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlake.llm.common import give_back, read_table, write_and_read

#: Rows a block of the flight phase has on average.
BLOCK_ROWS = 2048
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Times a source, and a document, may be taken at most.
MOST = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, n_docs, source_size, target): shares by weight, none above ``most`` x its size.

    All excess is shared again by weight until none is above. That ends at one level L with
    target = min(L x weight, most x size): sources are capped in the order of size / weight,
    as long as the next cap lies below what would then be left for its weight.
    One row per source takes part in the unpartitioned windows.
    """
    per_source = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int"))
    known = per_source.withColumn("weight", weight)
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    from_here = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    ranked = (
        known.withColumn("turn", F.row_number().over(by_cap))
        .withColumn("rest_weight", F.sum("weight").over(from_here))
        .withColumn("rest", F.sum("source_size").over(everything))
        .withColumn("from_here", F.sum("source_size").over(from_here))
        .withColumn("rest", F.col("rest") - most * (F.col("rest") - F.col("from_here")))
    )
    cap = most * F.col("source_size")
    open_ = cap * F.col("rest_weight") > F.col("rest") * F.col("weight")
    first_open = F.min(F.when(open_, F.struct("turn", "rest", "rest_weight"))).over(everything)
    share = F.col("level.rest") * F.col("weight") / F.col("level.rest_weight")
    return ranked.withColumn("level", first_open).select(
        "source",
        "n_docs",
        "source_size",
        F.least(cap.cast("double"), F.coalesce(share, cap.cast("double"))).alias("target"),
    )


def _uniform(*parts: object) -> float:
    digest = hashlib.blake2b(repr(parts).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little") / 2.0**64


def flight(sizes: np.ndarray, chances: np.ndarray, seed: object) -> np.ndarray:
    """Move ``chances`` until at most two are open; totals of size x chance and chance stay.

    Three open units at a time: (s2 - s3, s3 - s1, s1 - s2) changes neither total, or
    (1, -1, 0) if the sizes are equal. The direction is drawn so that expectations hold.
    """
    x = chances.astype(float).copy()
    active: list[int] = []
    for i in np.flatnonzero((x > 0) & (x < 1)):
        active.append(int(i))
        if len(active) < 3:
            continue
        s = [float(sizes[j]) for j in active]
        u = (s[1] - s[2], s[2] - s[0], s[0] - s[1])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - x[j]) / d if d > 0 else -x[j] / d for j, d in zip(active, u, strict=True) if d)
        down = min(x[j] / d if d > 0 else (x[j] - 1) / d for j, d in zip(active, u, strict=True) if d)
        step = up if _uniform(seed, active[0], int(i)) * (up + down) < down else -down
        for j, d in zip(active, u, strict=True):
            x[j] += step * d
            x[j] = 0.0 if x[j] < 1e-9 else 1.0 if x[j] > 1 - 1e-9 else x[j]
        active = [j for j in active if 0 < x[j] < 1]
        if len(active) == 3:  # rounding kept all three just inside: settle the nearest
            j = min(active, key=lambda a: min(x[a], 1 - x[a]))
            x[j] = round(x[j])
            active.remove(j)
    return x


def landing(sizes: np.ndarray, chances: np.ndarray, open_before: np.ndarray) -> np.ndarray:
    """Round the last open units (two at most) to the nearest total size, then the nearest count.

    A long document that is left open can miss the total by half its size. So the rest of
    the gap is filled by turning over units that were open before the flight, the longest
    that fits first: words come near their total, and documents give way a little.
    """
    x = chances.copy()
    open_ = np.flatnonzero((x > 0) & (x < 1))
    words, count = float(sizes[open_] @ x[open_]), float(x[open_].sum())
    if len(open_):
        x[open_] = min(
            product((0.0, 1.0), repeat=len(open_)),
            key=lambda c: (abs(float(sizes[open_] @ np.array(c)) - words), abs(sum(c) - count), c),
        )
    missing = words - float(sizes[open_] @ x[open_])
    able = np.setdiff1d(np.flatnonzero(open_before), open_)
    for j in able[np.argsort(-sizes[able], kind="stable")]:
        gain = float(sizes[j]) * (1 - 2 * x[j])
        if abs(missing - gain) < abs(missing):
            x[j] = 1 - x[j]
            missing -= gain
    return x


def _settle(level: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # Rows that tie are equal in all that counts, so their order does not matter.
        order = ["size", "doc_id", "mark", "copy"]
        rows = rows.sort_values(order, ascending=[False, True, True, True], na_position="last")
        rows = rows.reset_index(drop=True)
        sizes = rows["size"].to_numpy(np.int64)
        x = flight(sizes, rows["chance"].to_numpy(float), (level, str(key[0]), int(key[1])))
        if rows["blocks"].iloc[0] == 1:
            chance = rows["chance"].to_numpy(float)
            x = landing(sizes, x, (chance > 0) & (chance < 1))
        give_back()
        return rows.assign(chance=x)

    return run


_UNIT = (
    "doc_id long, mark long, copy long, row long, source string, size long, source_size long, target double,"
    " whole int, chance double"
)


def _copies_numbered(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``copy``: rows with one doc_id and one text are numbered from 0.

    Counted per written partition first, so that rows that say the same never meet in one task.
    """
    key = ("doc_id", "mark", "part")
    placed = sizes.withColumn("part", F.shiftright("at", 33))
    before = Window.partitionBy("doc_id", "mark").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*key).agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(before))
    offsets = offsets.filter("n > 1 or before is not null").toDF("of_id", "of_mark", "of_part", "n", "before")
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(key, ("of_id", "of_mark", "of_part"), strict=True)]
    within = F.row_number().over(Window.partitionBy(*key).orderBy("at")) - 1
    numbered = placed.withColumn("within", within).join(offsets, same[0] & same[1] & same[2], "left")
    copy = (F.col("within") + F.coalesce("before", F.lit(0))).cast("long")
    return numbered.withColumn("copy", copy).drop("within", "part", "at", "n", "before", "of_id", "of_mark", "of_part")


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    row: str | None = None,
) -> DataFrame:
    """Per row of ``docs``: doc_id, row, source, size, source_size, target, copies, taken.

    ``copies`` (0 to ``most``) is how often the mix takes the row, ``taken`` = copies x size.
    A NULL or empty text has size 0 and costs nothing to take; a NULL source is a source of
    its own, the last. If all sizes are 0, so are all targets. Rows that share a doc_id are
    separate units; ``row`` names a column of numbers that tells them apart in the result.
    Nothing depends on partitioning or on chance, so reruns agree. Other columns are ignored.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        (F.col(row) if row else F.lit(None)).cast("long").alias("row"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("mark"),
    )
    sizes = write_and_read(rows.withColumn("at", F.monotonically_increasing_id()), "mix_sizes")
    wanted = write_and_read(targets(sizes, weights, most), "mix_targets")
    # A source's row count never decides what is drawn where; only the number of blocks follows it.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BLOCK_ROWS)).cast("int")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per_source = wanted.select(
        F.col("source").alias("its"), "source_size", "target", blocks.alias("blocks"),
        ratio.alias("ratio"), F.floor(ratio).cast("int").alias("whole"),
    )
    units = _copies_numbered(sizes).join(per_source, F.col("source").eqNullSafe(F.col("its"))).withColumn(
        "chance", F.col("ratio") - F.col("whole")
    )
    done, level = [], 0
    while True:
        dealt = units.withColumn(
            "block", F.pmod(F.xxhash64("doc_id", "mark", "copy", F.lit(level)), F.col("blocks")).cast("int")
        ).select(*[c.split()[0] for c in _UNIT.split(",")], "blocks", "block")
        settled = write_and_read(
            dealt.groupBy("source", "block").applyInPandas(
                _settle(level), f"{_UNIT}, blocks int, block int"
            ),
            f"mix_level{level}",
        )
        fractional = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(settled.filter(~fractional))
        units = settled.filter(fractional)
        if units.isEmpty():
            break
        # Two open units a block at most meet again, half as many blocks' worth of rows or fewer.
        units = units.withColumn("blocks", F.ceil(F.col("blocks") * 2 / BLOCK_ROWS).cast("int"))
        level += 1
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    copies = (F.col("whole") + F.round("chance").cast("int")).alias("copies")
    return result.select("doc_id", "row", "source", "size", "source_size", "target", copies).withColumn(
        "taken", F.col("copies") * F.col("size")
    )


def resample(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs`` (doc_id, text, source, …) as often as they are taken.

    Rows are told apart by a number they get when they are written, so repeated rows and NULL
    ids are rows of their own. Other columns may have any name.
    """
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    numbered = docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*columns).alias("rest"))
    numbered = write_and_read(numbered, "mix_rows")
    at = {c: F.col(f"rest.c{docs.columns.index(c)}").alias(c) for c in ("doc_id", "text", "source")}
    taken = mix(numbered.select("number", *at.values()), row="number").filter("copies > 0").select("row", "copies")
    found = numbered.join(taken, F.col("number") == F.col("row"))
    repeated = found.select("rest", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return repeated.select(*[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken")
    )
