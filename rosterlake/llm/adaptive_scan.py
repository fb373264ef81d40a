"""Approximate nearest neighbours by inner product, with an adaptive dimension scan.

Vectors get one more component that makes them equally long, which turns the largest inner
product into the smallest distance. They are dealt to lists by the nearest of some
centroids, and each query probes its nearest lists. Everything is rotated at random, so a
distance over the first d of D dimensions, scaled by D / d, estimates the whole one with a
known spread. Candidates are scanned in blocks of columns; after each block a hypothesis
test abandons those that are too far already, measured against the distance of the k-th
best so far (at first the k-th best of a sample). What is left is scored exactly, on the
original vectors.

Lists are packed into blocks of bounded size, of candidates and of queries, and joined by
list, so a list with a third of all rows is many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlake.llm.common import read_table, write_and_read
from rosterlake.llm.vectors import matrix, usable

K = 20
#: Vectors that centroids and first thresholds come from, and their size in bytes at most.
FIT_ROWS, FIT_BYTES = 8192, 32 << 20
#: Lists at most, and sample vectors per list at least.
MOST_LISTS, ROWS_PER_CENTROID = 1024, 16
#: So many lists are probed that this share of the nearest neighbours within the sample lies in them.
WANTED, WANTED_QUERIES = 0.97, 512
#: Rows of a block, columns scanned between two tests, and the test's strictness.
BLOCK_ROWS, QUERY_ROWS, COLUMNS, STRICTNESS = 1024, 256, 16, 2.1


class Index:
    """Rotation, centroids and thresholds; as large as the sample's bound, whatever the data."""

    def __init__(self, ids: np.ndarray, dims: np.ndarray, sample: np.ndarray, longest: float, n_rows: int, k: int, wanted: float = WANTED, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.ids, self.dims, self.k = ids, dims, k
        self.longest = longest
        self.width = sample.shape[1]
        self.rotation = np.linalg.qr(rng.normal(size=(self.width + 1, self.width + 1)))[0]
        self.sample = sample
        points = self.rotated(sample)
        n = int(min(MOST_LISTS, max(1, len(points) // ROWS_PER_CENTROID), max(1, round(n_rows**0.5 / 2))))
        centroids = points[rng.permutation(len(points))[:n]]
        for _ in range(10):
            nearest = self._distances(points, centroids).argmin(1)
            total = np.zeros_like(centroids)
            np.add.at(total, nearest, points)
            count = np.bincount(nearest, minlength=n)
            centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
        self.centroids = centroids
        self.points = points
        self.probes = self._probes_for(wanted)

    def _probes_for(self, wanted: float) -> int:
        some = np.arange(min(WANTED_QUERIES, len(self.sample)))
        if len(self.sample) <= self.k + 1:
            return len(self.centroids)
        queries = self.rotated_queries(self.sample[some])
        distance = self._distances(queries, self.points)
        distance[some, some] = np.inf
        near = np.argpartition(distance, self.k, axis=1)[:, : self.k]
        lists = self._distances(self.points, self.centroids).argmin(1)
        turn = self._distances(queries, self.centroids).argsort(1).argsort(1)
        needed = np.sort(np.take_along_axis(turn, lists[near], 1).ravel())
        return int(needed[min(len(needed) - 1, int(wanted * len(needed)))]) + 1

    @staticmethod
    def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :], 0)

    def rotated(self, v: np.ndarray) -> np.ndarray:
        """Scaled to the longest vector, made equally long, rotated."""
        v = v / self.longest
        rest = np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))
        return np.column_stack([v, rest]) @ self.rotation

    def rotated_queries(self, v: np.ndarray) -> np.ndarray:
        """Queries point somewhere, their length does not matter; they have no part in the added component."""
        v = v / np.abs(v).max(1, keepdims=True)
        v = v / np.sqrt((v * v).sum(1, keepdims=True))
        return np.column_stack([v, np.zeros(len(v))]) @ self.rotation

    def nearest_lists(self, points: np.ndarray, n: int) -> np.ndarray:
        distance = self._distances(points, self.centroids)
        some = np.argpartition(distance, n - 1, axis=1)[:, :n] if n < distance.shape[1] else np.argsort(distance, axis=1)
        return some

    def sample_distances(self, queries: np.ndarray, dims: np.ndarray) -> np.ndarray:
        distance = self._distances(queries, self.points)
        distance[dims[:, None] != self.dims[None, :]] = np.inf
        return distance

    def thresholds(self, distance: np.ndarray) -> np.ndarray:
        """Upper bound of each query's k-th smallest distance to others: the sample may hold the query itself."""
        if distance.shape[1] <= self.k:
            return np.full(len(distance), np.inf)
        return np.partition(distance, self.k, axis=1)[:, self.k]


def scored(query_id: int, query: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query_id, vec_id, score) of the k largest inner products, the query itself left out."""
    other = ids != query_id
    ids, score = ids[other], (v[other] * query).sum(1)
    best = np.lexsort((ids, -score))[:k]
    return np.full(len(best), query_id), ids[best], score[best]


def _found(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    columns = [np.concatenate([x[c] for x in [none, *parts]]) for c in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def _seeds(shared):
    """Each query's best of the sample, so that none ends with fewer than it can have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q, ids = matrix(part.column("embedding"), index.width), part.column("vec_id").to_numpy()
                distance = index.sample_distances(index.rotated_queries(q), part.column("dim").to_numpy())
                near = np.argsort(distance, axis=1, kind="stable")[:, : index.k + 1]
                out = []
                for i in range(len(ids)):
                    some = near[i][np.isfinite(distance[i, near[i]])]
                    out.append(scored(ids[i], q[i], index.ids[some], index.sample[some], index.k))
                yield _found(out)

    return run


def adaptive_scan(queries: np.ndarray, points: np.ndarray, thresholds: np.ndarray, k: int, strictness: float = STRICTNESS) -> list[np.ndarray]:
    """By query: positions of the points that no test abandoned."""
    width = points.shape[1]
    edges = [*range(0, width, COLUMNS), width]
    blocks = [np.ascontiguousarray(points[:, a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    # The first columns are read for all candidates of all queries, so they are one product.
    q0 = queries[:, : edges[1]]
    first = (q0 * q0).sum(1)[:, None] - 2 * (q0 @ blocks[0].T) + (blocks[0] * blocks[0]).sum(1)[None, :]
    found = []
    for i, query in enumerate(queries):
        partial, alive, limit = first[i], np.arange(len(points)), thresholds[i]
        for block, a, b in zip(blocks, edges[:-1], edges[1:], strict=True):
            if a:
                difference = block[alive] - query[a:b]
                partial = partial + np.einsum("ij,ij->i", difference, difference)
            if b < width:
                near = partial * (width / b) <= limit * (1 + strictness / np.sqrt(b)) ** 2 + 1e-9
                alive, partial = alive[near], partial[near]
                if not len(alive):
                    break
        if len(alive) > k:
            limit = min(limit, np.partition(partial, k)[k])
            alive = alive[partial <= limit + 1e-9]
        found.append(alive)
    return found


def _deal(shared, query_every: int):
    """Vectors -> a row per list: as a candidate of its list, and as a query of the lists it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = part.column("vec_id").to_numpy()
                v = matrix(part.column("embedding"), index.width)
                lists = index.nearest_lists(index.rotated(v), 1)[:, 0]
                asks = np.flatnonzero(ids % query_every == 0)
                q = index.rotated_queries(v[asks])
                probed = index.nearest_lists(q, index.probes) if len(asks) else np.zeros((0, 1), int)
                limit = index.thresholds(index.sample_distances(q, part.column("dim").to_numpy()[asks])) if len(asks) else np.zeros(0)
                who = np.concatenate([np.arange(len(ids)), np.repeat(asks, probed.shape[1])])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([lists, probed.ravel()]).astype(np.int32)),
                        pa.array(np.repeat([False, True], [len(ids), probed.size])),
                        part.column("vec_id").take(pa.array(who)),
                        part.column("dim").take(pa.array(who)),
                        part.column("embedding").take(pa.array(who)),
                        pa.array(np.concatenate([np.zeros(len(ids)), np.repeat(limit, probed.shape[1])])),
                    ],
                    names=["list", "asks", "vec_id", "dim", "embedding", "threshold"],
                )

    return run


def _packed(shared):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        width = shared.value.width
        order = np.argsort(rows.column("vec_id").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        v = matrix(rows.column("embedding").combine_chunks(), width)
        return pa.table(
            {
                "list": pa.array([key[0].as_py()], pa.int32()),
                "dim": pa.array([key[1].as_py()], pa.int32()),
                "asks": pa.array([key[2].as_py()]),
                "ids": pa.array([rows.column("vec_id").to_numpy().astype("<i8").tobytes()]),
                "vectors": pa.array([v.tobytes()]),
                "thresholds": pa.array([rows.column("threshold").to_numpy().tobytes()]),
            }
        )

    return run


def _scan(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids, q_ids = (np.frombuffer(row[c], "<i8") for c in ("ids", "q_ids"))
                v = np.frombuffer(row["vectors"]).reshape(len(ids), index.width)
                q = np.frombuffer(row["q_vectors"]).reshape(len(q_ids), index.width)
                limits = np.frombuffer(row["q_thresholds"])
                found = adaptive_scan(index.rotated_queries(q), index.rotated(v), limits, k)
                yield _found([scored(q_ids[i], q[i], ids[some], v[some], k) for i, some in enumerate(found)])

    return run


def nearest(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = K,
    query_every: int = 20,
    wanted: float = WANTED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, nearest first.

    Queries are the vectors whose id is divisible by ``query_every``, candidates all
    others of the same length; near is a large inner product in double precision, ties go to
    the smaller vec_id. Every vector is in the index; the sample only shapes its lists.

    Vectors that are NULL, empty, zero or hold NULL, NaN or infinite components take no
    part, nor do those without a vec_id. Of rows that share a vec_id the smallest vector
    counts, once. Fewer than k candidates give fewer rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = write_and_read(
        rows.filter(usable("embedding") & F.col("vec_id").isNotNull())
        .groupBy("vec_id")
        .agg(F.min("embedding").alias("embedding"))
        .withColumn("dim", F.size("embedding")),
        "vectors",
    )
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    facts = rows.agg(F.count("*").alias("n"), F.max("dim").alias("dim"), F.max(length).alias("longest")).first()
    result = "query_id long, vec_id long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = int(min(FIT_ROWS, max(256, FIT_BYTES // (8 * facts["dim"]))))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("vec_id", "dim", "embedding").toArrow()
    sample = matrix(drawn.column("embedding").combine_chunks(), facts["dim"])
    ids, dims = drawn.column("vec_id").to_numpy(), drawn.column("dim").to_numpy()
    index = Index(ids, dims, sample, max(facts["longest"], 1e-300), facts["n"], k, wanted)
    shared = spark.sparkContext.broadcast(index)
    dealt = write_and_read(
        rows.mapInArrow(
            _deal(shared, query_every), "list int, asks boolean, vec_id long, dim int, embedding array<double>, threshold double"
        ),
        "dealt",
    )
    sizes = dealt.groupBy("list", "asks").agg(F.count("*").alias("n"))
    per_block = F.when(F.col("asks"), QUERY_ROWS).otherwise(BLOCK_ROWS)
    parts = sizes.select("list", "asks", F.ceil(F.col("n") / per_block).cast("int").alias("parts"))
    # One row per list and kind, so bounded by the number of lists.
    blocked = dealt.join(F.broadcast(parts), ["list", "asks"]).withColumn(
        "part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    )
    packed = write_and_read(
        blocked.groupBy("list", "dim", "asks", "part").applyInArrow(
            _packed(shared), "list int, dim int, asks boolean, ids binary, vectors binary, thresholds binary"
        ),
        "packed",
    )
    candidates = packed.filter("not asks").select("list", "dim", "ids", "vectors")
    queries = packed.filter("asks").select("list", "dim", *[F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "thresholds")])
    scanned = candidates.join(queries, ["list", "dim"]).mapInArrow(_scan(shared, k), result)
    seeds = rows.filter(F.col("vec_id") % query_every == 0).mapInArrow(_seeds(shared), result)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    # A pair may be found twice, as a seed and in its list.
    twice_k = scanned.unionByName(seeds).withColumn("turn", F.row_number().over(best)).filter(F.col("turn") <= 2 * k)
    found = twice_k.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op3_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))
