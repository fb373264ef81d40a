"""N-gram Jaccard join with signature trees.

Documents are sets of hashed word shingles. Two sets with Jaccard >= t have at least t of
either in common, so a document with fewer shared shingles (found in another document too)
links with nothing; a count over all blocks settles that. Equal sets become one
representative. Of the others each takes its prefix: in an order that puts rare shingles
first, the first n - ceil(t n) + 1, of which linked sets share at least one. Sets connected
through prefix shingles form a cluster, and only sets of one cluster are compared.

A cluster lies in blocks in the order of set size. Blocks, and within them the nodes of
binary trees down to leaves of some documents, carry the OR of their documents' token
bitmaps, their size range and least bitmap population, which bound the overlap any two of
their documents can have. A dual traversal of two trees skips node pairs whose bound is too
small; all pairs that are left are compared exactly, so every link is found and counted.

A pair of blocks hands on one row per representative: the sum of the weights it links with
and the first representative it is connected to. Links are never listed one by one, but a
cluster of near copies is compared pair by pair, which grows with the square of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rosterlake.llm.blocks import (
    BUCKET_BYTES,
    NO_ID,
    block_content,
    carried,
    bucket_count,
    counts_told,
    document_counts,
    make_blocks,
)
from rosterlake.llm.common import WORD_SPACE, give_back, read_table, write_and_read
from rosterlake.llm.components import components

WORDS = 4
#: Jaccard similarity from which documents link, in percent.
PERCENT = 85
#: 64-bit words of a token bitmap.
BITMAP_WORDS = 32
LEAF_ROWS, BLOCK_ROWS, BLOCK_TOKENS = 32, 512, 1 << 18
#: Factor between sizes of two bands, and blocks of a band that meet others in one place.
BAND, BAND_BLOCKS = 1.25, 256
#: Text of a block of documents.
TEXT_BYTES = 1 << 20

_FACTOR = 0x9E3779B97F4A7C15
_BYTE_HASH = np.random.RandomState(11).randint(0, 2**62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_HASH[0x41:0x5B] = _BYTE_HASH[0x61:0x7B]  # A-Z count as a-z
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for factor in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
        steps = np.full(n, factor, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word of the texts that lie one after the other in ``data``."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~WORD_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    begins = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    power, inverse = _powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_HASH[data] * power, dtype=np.uint64)])
    hashed = (total[ends] - total[begins]) * inverse[begins]
    return _mixed(hashed + (ends - begins).astype(np.uint64) * _MIX[2]), np.searchsorted(offsets, begins, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges): the distinct shingles of document i, ascending, are hashes[edges[i]:edges[i+1]]."""
    word, doc = word_hashes(data, offsets)
    n_docs = len(offsets) - 1
    counts = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(counts)])
    left = counts[doc] - (np.arange(len(word)) - first[doc])  # words from here to the document's end
    short = counts[doc] < words
    at = np.flatnonzero((left >= words) | (short & (left == counts[doc])))
    length = np.minimum(left[at], words)
    shingle = length.astype(np.uint64) * _MIX[2]
    for i in range(words):
        nxt = word[np.minimum(at + i, len(word) - 1)] if len(word) else word
        shingle = np.where(i < length, _mixed(shingle * _MIX[3] + nxt), shingle)
    doc = doc[at]
    order = np.argsort(shingle, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    shingle, doc = shingle[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    return shingle[new], np.searchsorted(doc[new], np.arange(n_docs + 1))


def _features(words: int):
    def of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shingles, _ = shingle_sets(data, offsets, words)
        return np.unique(shingles, return_counts=True)

    return of


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(percent of n): what a set of size n must share with any set it links with."""
    return -(-percent * n // 100)


def row_numbers(block: int, n: int) -> np.ndarray:
    """A number for each of a block's ``n`` rows, from the block's own (task << 32 | count)."""
    return (((block >> 32 << 21) | (block & 0xFFFFFFFF)) << 21) + np.arange(n)


def _sets(buckets: int, words: int, percent: int, numbered: bool):
    """Block and answers -> a row per document; tokens only where it can link."""

    def run(key: tuple, block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = {"doc_id": [], "its": [], "n": [], "tokens": [], "rare": []}
        if len(block):
            ids, data, offsets = block_content(block.iloc[0])
            out["its"] = [None if i == NO_ID else int(i) for i in ids]
            if numbered:
                ids = row_numbers(int(block["block"].iloc[0]), len(ids))
            shingles, edges = shingle_sets(data, offsets, words)
            keys = np.unique(shingles)
            known = counts_told(keys, told, buckets)[np.searchsorted(keys, shingles)] if len(keys) else keys
            shared = np.concatenate([[0], np.cumsum(known > 1)])
            n = np.diff(edges)
            links = (n > 0) & (ids != NO_ID) & (np.diff(shared[edges]) >= least_overlap(n, percent))
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                out["doc_id"].append(None if ids[i] == NO_ID else int(ids[i]))
                out["n"].append(int(b - a))
                out["tokens"].append(shingles[a:b].tobytes() if links[i] else None)
                out["rare"].append(prefix(shingles[a:b], known[a:b], percent).tobytes() if links[i] else None)
            give_back()
        return pd.DataFrame(out).astype({"doc_id": "Int64", "its": "Int64"})

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each prefix shingle of each representative."""
    for batch in batches:
        parts = [np.frombuffer(x, np.int64) for x in batch.column("rare").to_pylist()]
        reps = np.repeat(batch.column("key").to_numpy(), [len(x) for x in parts])
        tokens = np.concatenate([*parts, np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(tokens)], names=["key", "token"])


def prefix(tokens: np.ndarray, df: np.ndarray, percent: int) -> np.ndarray:
    """The tokens, of the first n - ceil(t n) + 1 in (df, hash) order, that others have too."""
    n = len(tokens)
    first = np.lexsort((tokens, df))[: n - int(least_overlap(n, percent)) + 1]
    return tokens[first][df[first] > 1].view(np.int64)


class Block:
    """Some documents of one cluster, by size, with their weights, tokens and token bitmaps."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, weights: np.ndarray):
        self.ids, self.sizes, self.tokens, self.weights = ids, sizes, tokens, weights
        self.edges = np.concatenate([[0], np.cumsum(sizes)])
        bit = (tokens >> np.uint64(40)) % np.uint64(64 * BITMAP_WORDS)
        flat = np.zeros(len(ids) * 64 * BITMAP_WORDS, bool)
        flat[np.repeat(np.arange(len(ids)), sizes) * 64 * BITMAP_WORDS + bit.astype(np.int64)] = True
        self.bits = np.packbits(flat.reshape(len(ids), -1), axis=1).view(np.uint64)
        self.population = np.bitwise_count(self.bits).sum(1).astype(np.int64)
        self.nodes: dict[tuple[int, int], tuple] = {}

    def node(self, a: int, b: int) -> tuple:
        """(OR bitmap, least and largest size, least population) of documents a to b."""
        if (a, b) not in self.nodes:
            self.nodes[a, b] = (
                np.bitwise_or.reduce(self.bits[a:b], axis=0),
                int(self.sizes[a:b].min()),
                int(self.sizes[a:b].max()),
                int(self.population[a:b].min()),
            )
        return self.nodes[a, b]


def possible(x: tuple, y: tuple, percent: int) -> bool:
    """Whether any document under node x can link with any under node y."""
    if 100 * min(x[2], y[2]) < percent * max(x[1], y[1]):
        return False
    common = int(np.bitwise_count(x[0] & y[0]).sum())
    # A document's bits outside of the other node's are tokens it cannot share.
    most = min(x[2] - max(0, x[3] - common), y[2] - max(0, y[3] - common))
    return (100 + percent) * most >= percent * (x[1] + y[1])


class _Union:
    def __init__(self, groups: np.ndarray):
        first: dict[int, int] = {}
        self.parent = [first.setdefault(int(g), i) for i, g in enumerate(groups)]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i


def connect(a: Block, b: Block, same: bool, percent: int, union: _Union | None = None) -> np.ndarray:
    """All links, as rows (position in a, position in b), by dual traversal; i < j if a is b.

    ``union``, over the positions of a (and then of b, if it is another block), gets joined by them.
    """
    shift = 0 if same else len(a.ids)
    vocabulary, dense = np.unique(a.tokens if same else np.concatenate([a.tokens, b.tokens]), return_inverse=True)
    dense_a, dense_b = dense[: len(a.tokens)], dense if same else dense[len(a.tokens) :]
    has = np.zeros(len(vocabulary), bool)
    links = [np.zeros((0, 2), np.int64)]

    def leaves(a0: int, a1: int, b0: int, b1: int) -> None:
        every = np.arange(b0, b1)
        tokens, starts = dense_b[b.edges[b0] : b.edges[b1]], b.edges[b0:b1] - b.edges[b0]
        for i in range(a0, a1):
            rest = every[every > i] if same else every
            if not len(rest):
                continue
            n, m = a.sizes[i], b.sizes[rest]
            outside = np.bitwise_count(a.bits[i] & ~b.bits[rest]).sum(1).astype(np.int64)
            inside = np.bitwise_count(a.bits[i] & b.bits[rest]).sum(1).astype(np.int64)
            most = np.minimum(n - outside, m - (b.population[rest] - inside))
            rest = rest[(100 + percent) * most >= percent * (n + m)]
            if not len(rest):
                continue
            mine = dense_a[a.edges[i] : a.edges[i + 1]]
            has[mine] = True
            if 4 * len(rest) < b1 - b0:
                shared = np.array([np.count_nonzero(has[dense_b[b.edges[j] : b.edges[j + 1]]]) for j in rest])
            else:
                shared = np.add.reduceat(has[tokens], starts, dtype=np.int64)[rest - b0]
            has[mine] = False
            linked = rest[(100 + percent) * shared >= percent * (n + b.sizes[rest])]
            links.append(np.stack([np.full(len(linked), i), linked], axis=1))
            for j in linked.tolist() if union else ():
                x, y = union.find(i), union.find(shift + j)
                if x != y:
                    union.parent[max(x, y)] = min(x, y)

    def traverse(a0: int, a1: int, b0: int, b1: int) -> None:
        if same and b1 <= a0 + 1 or not possible(a.node(a0, a1), b.node(b0, b1), percent):
            return
        if a1 - a0 <= LEAF_ROWS and b1 - b0 <= LEAF_ROWS:
            leaves(a0, a1, b0, b1)
        elif a1 - a0 >= b1 - b0:
            mid = (a0 + a1) // 2
            traverse(a0, mid, b0, b1)
            traverse(mid, a1, b0, b1)
        else:
            mid = (b0 + b1) // 2
            traverse(a0, a1, b0, mid)
            traverse(a0, a1, mid, b1)

    traverse(0, len(a.ids), 0, len(b.ids))
    return np.concatenate(links)


_BLOCK = (
    "block long, cluster long, smallest int, largest int, bitmap array<long>, lowest int, ids binary,"
    " sizes binary, weights binary, tokens binary"
)


def _lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cluster, n, key) -> blocks of one cluster each, numbered in that order."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held: list[tuple[int, int, int, bytes]] = []
    tokens, cluster = 0, None

    def cut() -> dict:
        nonlocal number, held, tokens
        ids = np.array([x[0] for x in held], "<i8")
        sizes = np.array([x[1] for x in held], "<i8")
        weights = np.array([x[2] for x in held], "<i8")
        content = b"".join(x[3] for x in held)
        block = Block(ids, sizes, np.frombuffer(content, np.uint64), weights)
        node = block.node(0, len(ids))
        row = {
            "block": number, "cluster": cluster, "smallest": node[1], "largest": node[2],
            "bitmap": node[0].view(np.int64).tolist(), "lowest": node[3],
            "ids": ids.tobytes(), "sizes": sizes.tobytes(), "weights": weights.tobytes(), "tokens": content,
        }
        number, held, tokens = number + 1, [], 0
        return row

    schema = pa.schema(
        [("block", pa.int64()), ("cluster", pa.int64()), ("smallest", pa.int32())]
        + [("largest", pa.int32()), ("bitmap", pa.list_(pa.int64())), ("lowest", pa.int32())]
        + [(c, pa.binary()) for c in ("ids", "sizes", "weights", "tokens")]
    )
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["cluster"] != cluster or len(held) >= BLOCK_ROWS or tokens >= BLOCK_TOKENS):
                yield pa.RecordBatch.from_pylist([cut()], schema)
            cluster = row["cluster"]
            held.append((row["key"], row["n"], row["weight"], row["tokens"]))
            tokens += row["n"]
    if held:
        yield pa.RecordBatch.from_pylist([cut()], schema)


def _connect(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                same = row["a_block"] == row["b_block"]

                def side(s: str, row=row) -> Block:
                    ids, sizes, weights = (np.frombuffer(row[f"{s}_{c}"], "<i8") for c in ("ids", "sizes", "weights"))
                    return Block(ids, sizes, np.frombuffer(row[f"{s}_tokens"], np.uint64), weights)

                a = side("a")
                b = a if same else side("b")
                ids = a.ids if same else np.concatenate([a.ids, b.ids])
                union = _Union(np.arange(len(ids)))
                i, j = connect(a, b, same, percent, union).T
                j_all = j if same else j + len(a.ids)
                links = np.bincount(i, b.weights[j], len(ids)) + np.bincount(j_all, a.weights[i], len(ids))
                linked = np.flatnonzero(links > 0)
                first = np.array([union.find(k) for k in linked.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[linked]), pa.array(ids[first]), pa.array(links[linked].astype(np.int64))],
                    names=["a", "b", "links"],
                )
        give_back()

    return run


def _linked_blocks(pairs: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    content = ["block", "ids", "sizes", "weights", "tokens"]
    left = blocks.select(*[F.col(c).alias(f"a_{c}") for c in content])
    right = blocks.select(*[F.col(c).alias(f"b_{c}") for c in content])
    # Pairs differ much in the work they are, little in size: deal them out one by one.
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = pairs.join(left, "a_block").join(right, "b_block").repartition(parts, "a_block", "b_block")
    return joined.mapInArrow(_connect(percent), "a long, b long, links long")


def _band(size: Column) -> Column:
    """Sizes of a factor of BAND or less apart fall into one band or two neighbouring ones."""
    return F.floor(F.log(BAND, size)).cast("int")


def _block_pairs(blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs of a cluster's blocks that may hold links; each block with itself, too.

    Blocks meet by cluster and band of sizes: a block stands in the band of its smallest set
    and looks into all bands in which a set may begin that its own can link with. Where more
    than BAND_BLOCKS stand in one band they are dealt out, and those that look visit every part.
    """
    boxes = ["block", "smallest", "largest", "bitmap", "lowest"]
    b = blocks.select("cluster", _band(F.col("smallest")).alias("band"), *[F.col(c).alias(f"b_{c}") for c in boxes])
    last = _band(F.col("largest") * 100 / percent)
    a = blocks.select(
        "cluster",
        F.explode(F.sequence(_band(F.col("smallest")), last)).alias("band"),
        *[F.col(c).alias(f"a_{c}") for c in boxes],
    )
    crowded = b.groupBy("cluster", "band").count().filter(F.col("count") > BAND_BLOCKS)
    crowded = crowded.select("cluster", "band", F.ceil(F.col("count") / BAND_BLOCKS).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    b = b.join(crowded, ["cluster", "band"], "left").withColumn("part", F.pmod(F.xxhash64("b_block"), parts).cast("int"))
    a = a.join(crowded, ["cluster", "band"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    common = F.aggregate(
        F.zip_with("a_bitmap", "b_bitmap", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x
    )
    most = F.least(
        *[F.col(f"{s}_largest") - F.greatest(F.lit(0), F.col(f"{s}_lowest") - common) for s in "ab"]
    )
    # A cluster's blocks are numbered in the order of size, so b has the larger sets.
    return (
        a.drop("parts")
        .join(b.drop("parts"), ["cluster", "band", "part"])
        .filter(F.col("a_block") <= F.col("b_block"))
        .filter(100 * F.col("a_largest") >= percent * F.col("b_smallest"))
        .filter((100 + percent) * most >= percent * (F.col("a_smallest") + F.col("b_smallest")))
        .select("a_block", "b_block")
    )


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, n_links, component_id.

    Words are what white space (blank, tab to carriage return) separates, A-Z in lower case;
    a set holds the distinct shingles of ``words`` words, or of all words if there are
    fewer. Documents link if 100 x intersection >= ``percent`` x union; ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest doc_id reachable.

    NULL, empty and blank texts have 0 shingles and link with nothing, as does a NULL
    doc_id (its component is NULL). Equal rows link with each other; rows that share a
    doc_id are documents of their own. Texts are read whole, whatever their length; other
    columns are ignored.
    """
    blocks = make_blocks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), TEXT_BYTES)
    return _linked(blocks, words, percent, numbered=False).drop("its")


def _linked(blocks: DataFrame, words: int, percent: int, numbered: bool) -> DataFrame:
    """``near_duplicates`` of the texts in ``blocks``; ``its`` is the doc_id.

    With ``numbered`` every row has a number of its own in place of the doc_id, so that rows with
    one doc_id or none are told apart.
    """
    spark = blocks.sparkSession
    buckets = bucket_count(blocks, BUCKET_BYTES // 2)
    told = document_counts(blocks, _features(words), buckets)
    sets = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(
        _sets(buckets, words, percent, numbered), "doc_id long, its long, n int, tokens binary, rare binary"
    )
    sets = write_and_read(
        sets.withColumn("digest", F.when(F.col("tokens").isNotNull(), F.sha2("tokens", 256))), "shingle_sets"
    )
    reps = write_and_read(
        sets.filter("tokens is not null")
        .groupBy("digest", "n")
        .agg(
            F.min("doc_id").alias("rep"),
            F.count("*").alias("weight"),
            F.first("tokens").alias("tokens"),
            F.first("rare").alias("rare"),
        )
        .withColumn("key", F.monotonically_increasing_id()),
        "set_representatives",
    )
    shared = reps.select("key", "rare").mapInArrow(_spread, "key long, token long")
    hubs = shared.groupBy("token").agg(F.min("key").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    hubs = write_and_read(hubs.select("token", "hub"), "prefix_hubs")
    together = shared.join(hubs, "token").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = components(together)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["cluster", "n", "key"]
    laid = (
        reps.join(clusters, reps.key == clusters.node)
        .select(F.col("component").alias("cluster"), "n", "key", "weight", "tokens")
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(_lay, _BLOCK)
    )
    laid = write_and_read(laid, "cluster_blocks")
    pairs = write_and_read(_block_pairs(laid, percent), "block_pairs")
    linked = _linked_blocks(pairs, laid, percent).groupBy("a", "b").agg(F.sum("links").alias("links"))
    linked = write_and_read(linked, "block_links")
    found = components(linked.select("a", "b"))
    counts = linked.groupBy("a").agg(F.sum("links").alias("links"))
    per_rep = (
        reps.join(counts, reps.key == counts.a, "left")
        .join(found, reps.key == found.node, "left")
        .select(
            F.col("digest").alias("d"),
            "rep",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "key").alias("group"),
        )
    )
    per_rep = write_and_read(per_rep, "per_representative")
    smallest = per_rep.groupBy("group").agg(F.min("rep").alias("component"))
    per_set = write_and_read(per_rep.join(smallest, "group").select("d", "n_links", "component"), "set_components")
    return sets.select("doc_id", "its", "n", "digest").join(per_set, F.col("digest") == F.col("d"), "left").select(
        "doc_id",
        "its",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )


def _pick(block: pa.Table, kept: pa.Table) -> pa.Table:
    """The rows of a block whose places are in ``kept``, in order."""
    row = block.to_pylist()[0]
    ids, data, offsets = block_content(row)
    at = np.sort(kept.column("place").to_numpy())
    texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in at]
    more = carried(row).take(pa.array(at))
    out = {"doc_id": pa.array(ids[at], mask=ids[at] == NO_ID), "text": pa.array(texts, pa.string())}
    give_back()
    return pa.table(out | {c: more.column(c) for c in more.column_names})


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` (with doc_id and text), all its columns, with one row of each group of near copies.

    The one with the smallest doc_id stays, NULL last; of rows that share it the first
    written. Rows with one doc_id, or none, are rows of their own, so of equal rows one stays. Texts without
    words link with nothing and all stay. Other columns may have any name.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]
    rows = docs.select("doc_id", "text", F.struct(F.col("text").isNotNull().alias("there"), *columns).alias("rest"))
    blocks = make_blocks(rows, TEXT_BYTES)
    found = _linked(blocks, words, percent, numbered=True)
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("its").isNull(), "its", "doc_id")).alias("first"))
    number = F.col("first.doc_id")
    block = F.shiftright(number, 42) * F.lit(1 << 32) + F.shiftright(number, 21).bitwiseAND(F.lit((1 << 21) - 1))
    kept = first.select(block.alias("block"), number.bitwiseAND(F.lit((1 << 21) - 1)).alias("place"))
    result = StructType([StructField("doc_id", LongType()), rows.schema["text"], rows.schema["rest"]])
    picked = blocks.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(_pick, result)
    back = {c: F.col(f"rest.c{i}") for i, c in enumerate(rest)}
    back |= {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.when(F.col("rest.there"), F.col("text"))}
    return picked.select(*[back[c].alias(c) for c in docs.columns])


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "n_links", "component_id")


ORACLE = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + {WORDS - 1}], ' ') for i in range(1, len(w) - {WORDS - 2})] END) AS s
  FROM words
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
), component AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
direct AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(n_links, 0)::BIGINT AS n_links, component_id
FROM sets JOIN component ON node = doc_id LEFT JOIN direct ON a = doc_id
"""
