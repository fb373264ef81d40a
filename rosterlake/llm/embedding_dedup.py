"""Embedding near-dedup by an epsilon grid order join.

Unit vectors at cosine >= t lie within eps = sqrt(2 - 2t) of each other. They are rotated
to their principal directions, and the leading ones are cut into cells of width eps: two
vectors that link differ by at most one cell in every one of them. Sorted by (label, cell,
cell, ...) the vectors form one sequence, cut into blocks that carry the bounding box of
their cells. Pairs of blocks whose boxes touch are found by an equi-join on the first two
cells; each pair is then joined recursively, halving the longer interval and skipping
halves that are provably distant, down to leaves compared by matrix product.

Equal vectors are one representative with a weight. A pair of blocks hands on one row per
linked vector (how many links, and one vector of its local component), never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.common import read_table, write_and_read
from rosterlake.llm.components import components
from rosterlake.llm.vectors import matrix, usable

#: Leading principal directions that are cut into cells.
GRID_DIMENSIONS = 6
#: Vectors in a block, and in a leaf of the recursion.
BLOCK_ROWS, LEAF_ROWS = 512, 64

_BLOCK = (
    "block long, label long, dim int, lo array<int>, hi array<int>,"
    " n int, ids binary, weights binary, cells binary, units binary"
)


def _cells(rotation: np.ndarray, eps: float):
    width, grid = rotation.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("embedding"), width)
            unit = _normalised(v)
            cells = np.floor(unit @ rotation / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("rep", "weight", "label", "dim", "embedding")]
                + [pa.array(cells[:, i]) for i in range(grid)],
                names=["rep", "weight", "label", "dim", "embedding"] + [f"c{i}" for i in range(grid)],
            )

    return run


def _normalised(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _blocks(width: int, grid: int, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def cut(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            rows = rows.combine_chunks()
            cells = np.stack([rows.column(f"c{i}").to_numpy() for i in range(grid)], axis=1).astype(np.int32)
            embedding = rows.column("embedding").combine_chunks()
            unit = _normalised(matrix(embedding, width))
            out = pa.RecordBatch.from_pylist(
                [
                    {
                        "block": number,
                        "label": rows.column("label")[0].as_py(),
                        "dim": rows.column("dim")[0].as_py(),
                        "lo": cells.min(0).tolist(),
                        "hi": cells.max(0).tolist(),
                        "n": len(cells),
                        "ids": rows.column("rep").to_numpy().astype("<i8").tobytes(),
                        "weights": rows.column("weight").to_numpy().astype("<i8").tobytes(),
                        "cells": cells.tobytes(),
                        "units": unit.tobytes(),
                    }
                ],
                schema=pa.schema(
                    [("block", pa.int64()), ("label", pa.int64()), ("dim", pa.int32())]
                    + [(c, pa.list_(pa.int32())) for c in ("lo", "hi")]
                    + [("n", pa.int32())]
                    + [(c, pa.binary()) for c in ("ids", "weights", "cells", "units")]
                ),
            )
            number += 1
            return out

        def full(rows: pa.Table, rest: bool) -> Iterator[tuple[pa.Table, bool]]:
            """Parts of one label and dim; (part, whether it is cut now)."""
            label, dim = rows.column("label").to_numpy(), rows.column("dim").to_numpy()
            breaks = np.flatnonzero((label[1:] != label[:-1]) | (dim[1:] != dim[:-1])) + 1
            edges = [0, *breaks.tolist(), len(label)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                while b - a >= block_rows or a < b and (rest or b < len(label)):
                    yield rows.slice(a, min(block_rows, b - a)), True
                    a = min(b, a + block_rows)
                if a < b:
                    yield rows.slice(a, b - a), False

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < block_rows:
                continue
            parts, held = list(full(pa.Table.from_batches(held), False)), []
            for part, now in parts:
                if now:
                    yield cut(part)
                else:
                    held += part.to_batches()
        if held and sum(b.num_rows for b in held):
            for part, _ in full(pa.Table.from_batches(held), True):
                yield cut(part)

    return run


class _Sequence:
    """An interval of the grid order; ``box`` gives the cells it spans."""

    def __init__(self, ids, weights, cells, units):
        self.ids, self.weights, self.cells, self.units = ids, weights, cells, units

    @classmethod
    def of(cls, row: dict, side: str, width: int, grid: int) -> _Sequence:
        n = row[f"{side}n"]
        return cls(
            np.frombuffer(row[f"{side}ids"], "<i8"),
            np.frombuffer(row[f"{side}weights"], "<i8"),
            np.frombuffer(row[f"{side}cells"], np.int32).reshape(n, grid),
            np.frombuffer(row[f"{side}units"], float).reshape(n, width),
        )


def join_sequences(a: _Sequence, b: _Sequence, same: bool, cosine: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Linked positions (i in a, j in b) of two intervals; i < j if they are the same one."""
    found = []

    def recurse(a0: int, a1: int, b0: int, b1: int) -> None:
        if same and b1 <= a0 + 1:
            return
        x, y = a.cells[a0:a1], b.cells[b0:b1]
        if (x.min(0) > y.max(0) + 1).any() or (y.min(0) > x.max(0) + 1).any():
            return
        if a1 - a0 <= LEAF_ROWS and b1 - b0 <= LEAF_ROWS:
            i, j = np.nonzero(a.units[a0:a1] @ b.units[b0:b1].T >= cosine - 1e-9)
            i, j = i + a0, j + b0
            # The product above sums in another order; borderline pairs are settled one by one.
            near = np.einsum("ij,ij->i", a.units[i], b.units[j]) >= cosine
            keep = near & (i < j) if same else near
            found.append((i[keep], j[keep]))
        elif a1 - a0 >= b1 - b0:
            mid = (a0 + a1) // 2
            recurse(a0, mid, b0, b1)
            recurse(mid, a1, b0, b1)
        else:
            mid = (b0 + b1) // 2
            recurse(a0, a1, b0, mid)
            recurse(a0, a1, mid, b1)

    recurse(0, len(a.ids), 0, len(b.ids))
    return found


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of ``n`` positions over links i-j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _join(width: int, grid: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                same = row["a_block"] == row["b_block"]
                a, b = (_Sequence.of(row, side, width, grid) for side in ("a_", "b_"))
                found = join_sequences(a, b, same, cosine)
                i = np.concatenate([x for x, _ in found] or [np.zeros(0, int)])
                j = np.concatenate([x for _, x in found] or [np.zeros(0, int)])
                if not len(i):
                    continue
                ids = a.ids if same else np.concatenate([a.ids, b.ids])
                j_all = j if same else j + len(a.ids)
                links = np.bincount(i, b.weights[j], len(ids)) + np.bincount(j_all, a.weights[i], len(ids))
                group = local_components(len(ids), i, j_all)
                linked = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[linked]), pa.array(ids[group[linked]]), pa.array(links[linked].astype(np.int64))],
                    names=["a", "b", "links"],
                )

    return run


def near_duplicates(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    cosine: float = 0.98,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not NULL, their lengths are equal, and their
    cosine in double precision is at least ``cosine``. ``n_links`` counts the other rows
    linked directly, ``component_id`` is the smallest vec_id reachable, ``kept`` marks the
    row that has it. Vectors that are NULL, empty, zero or hold NULL, NaN or infinite
    components link with nothing, and neither do those without a label or vec_id. Rows that
    share a vec_id are vectors of their own. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).cast("long").alias("label"),
        F.col(embedding).cast("array<double>").alias("embedding"),
    )
    takes_part = usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = write_and_read(rows.select("vec_id", "label", F.when(takes_part, F.col("embedding")).alias("embedding")), "vectors")
    reps = write_and_read(
        rows.filter("embedding is not null")
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
        .withColumn("dim", F.size("embedding")),
        "representatives",
    )
    width = reps.agg(F.max("dim")).first()[0]
    if width is None:
        alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return alone.withColumn("kept", F.lit(True))
    eps = math.sqrt(2 - 2 * cosine) * (1 + 1e-9) + 1e-9
    grid = min(GRID_DIMENSIONS, width)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    padded = F.concat(
        F.transform("embedding", lambda x: x / length), F.array_repeat(F.lit(0.0), F.lit(width) - F.col("dim"))
    )
    # The rotation is as large as a vector is wide; any rotation gives right results. PCA needs two rows.
    sound = reps.filter(length.between(1e-100, 1e100)).select(array_to_vector(padded).alias("unit"))
    if sound.limit(2).count() < 2:
        rotation = np.eye(width)[:, :grid]
    else:
        rotation = PCA(k=grid, inputCol="unit", outputCol="pc").fit(sound).pc.toArray()
        rotation = np.linalg.qr(rotation)[0]
    cells = ", ".join(f"c{i} int" for i in range(grid))
    placed = reps.mapInArrow(_cells(rotation, eps), f"rep long, weight long, label long, dim int, embedding array<double>, {cells}")
    order = ["label", "dim", *(f"c{i}" for i in range(grid)), "rep"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = write_and_read(
        placed.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(_blocks(width, grid, block_rows), _BLOCK),
        "grid_blocks",
    )
    boxes = blocks.select("block", "label", "dim", "lo", "hi")
    second = min(1, grid - 1)

    def keyed(side: str, margin: int) -> DataFrame:
        key = [F.sequence(F.col("lo")[i] - margin, F.col("hi")[i] + margin) for i in (0, second)]
        out = boxes.withColumn("k0", F.explode(key[0])).withColumn("k1", F.explode(key[1]))
        return out.select("label", "dim", "k0", "k1", *[F.col(c).alias(f"{side}_{c}") for c in ("block", "lo", "hi")])

    apart = F.exists(
        F.sequence(F.lit(0), F.lit(grid - 1)),
        lambda i: (F.get("a_lo", i) > F.get("b_hi", i) + 1) | (F.get("b_lo", i) > F.get("a_hi", i) + 1),
    )
    pairs = (
        keyed("a", 1)
        .join(keyed("b", 0), ["label", "dim", "k0", "k1"])
        .filter(F.col("a_block") <= F.col("b_block"))
        .filter(~apart)
        .select("a_block", "b_block")
        .distinct()
    )
    content = ["block", "n", "ids", "weights", "cells", "units"]
    left = blocks.select(*[F.col(c).alias(f"a_{c}") for c in content])
    right = blocks.select(*[F.col(c).alias(f"b_{c}") for c in content])
    joined = pairs.join(left, "a_block").join(right, "b_block").mapInArrow(
        _join(width, grid, cosine), "a long, b long, links long"
    )
    linked = write_and_read(
        joined.groupBy("a", "b").agg(F.sum("links").alias("links")), "block_links"
    )
    found = components(linked.select("a", "b"))
    counts = linked.groupBy("a").agg(F.sum("links").alias("links"))
    per_rep = (
        reps.join(counts, reps.rep == counts.a, "left")
        .join(found, reps.rep == found.node, "left")
        .select(
            F.col("label").alias("l"),
            F.col("embedding").alias("e"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    per_rep = write_and_read(per_rep, "per_representative")
    return rows.join(per_rep, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id,
       vec_id = component_id AS kept
FROM embeddings LEFT JOIN counts ON a = vec_id
JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) ON node = vec_id
"""
