"""Suffix-array dedup by merging Burrows-Wheeler transforms of shards.

The 50-byte strings of all texts are dealt by content: each belongs to the anchor it holds,
the 20-gram of smallest hash (the leftmost, if tied), so equal strings have equal anchors at
equal distance. Neighbouring strings of one anchor form a run. Anchors that stand in one
document only cannot belong to a repeat; a count over all blocks of documents leaves them out.

The runs of an anchor bucket are strings aligned at their anchors, a column per byte. Each
shard of them is transformed: from the last column to the first, its rows are kept in the
order of what follows, and a column of the transform is the symbols that precede, in that
order. The shards are merged by refining one interleave: it begins with the shards one
after the other and is sorted, stably, by one column of merged symbols after the other.
Nothing but the interleave moves, and no suffix is sorted again. At the anchor the common
prefixes of neighbouring suffixes are read off; each further column to the left splits the
intervals, and an interval whose rows share 50 bytes is a repeat, with a smallest document.

Within a block, equal runs are one row with their smallest document; only whether another
block has a smaller one is asked. So a passage that stands everywhere is one row a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rosterlake.llm.blocks import (
    NO_ID,
    block_content,
    bucket_count,
    by_bucket,
    carried,
    counts_told,
    document_counts,
    make_blocks,
    pack,
    unpack,
)
from rosterlake.llm.common import give_back, read_table

#: Length of the strings that must not repeat, and of the anchors in them.
LENGTH, GRAM = 50, 20
#: Distances a string's start can lie before its anchor: 0 to REACH.
REACH = LENGTH - GRAM
WIDTH = REACH + LENGTH
#: Rows of a shard whose transform is built on its own.
SHARD_ROWS = 8192
#: Text whose runs fill a merging bucket.
MERGE_BYTES = 4 << 20
#: Positions hashed at a time.
_SLICE = 1 << 17

_FACTOR = 0x9E3779B97F4A7C15
_BYTE_HASH = np.random.RandomState(7).randint(0, 2**62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hash of every ``gram`` bytes, by doubling."""
    doubled, size, out, have = _BYTE_HASH[data], 1, None, 0
    while True:
        if gram & size:
            if out is None:
                out, have = doubled, size
            else:
                n = len(data) - have - size + 1
                out = out[:n] * np.uint64(pow(_FACTOR, size, 1 << 64)) + doubled[have : have + n]
                have += size
        if have == gram:
            break
        n = len(data) - 2 * size + 1
        doubled = doubled[:n] * np.uint64(pow(_FACTOR, size, 1 << 64)) + doubled[size : size + n]
        size *= 2
    out = out ^ (out >> np.uint64(31))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, far, near, hash, document) of every run of strings with one anchor.

    The run's strings start ``near`` to ``far`` bytes before the anchor's position.
    """
    span = REACH + 1
    parts = []
    for at in range(0, max(0, len(data) - LENGTH + 1), _SLICE):
        piece = data[at : at + _SLICE + LENGTH - 1]
        starts = len(piece) - LENGTH + 1
        hashes = gram_hashes(piece)
        key = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        low, size = key, 1
        while size * 2 <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
        anchor = (low[:starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.arange(starts)
        # a string is inside its document: the next offset lies LENGTH or more behind its start
        doc = np.searchsorted(offsets, [at, at + starts - 1], "right") - 1
        inside = np.ones(starts, bool)
        for edge in offsets[doc[0] + 1 : doc[1] + 2]:
            inside[max(0, edge - at - LENGTH + 1) : max(0, edge - at)] = False
        change = np.flatnonzero(np.diff(np.where(inside, anchor, -1), prepend=-1, append=-1))
        first, behind = change[:-1], change[1:]
        real = inside[first]
        first, last = first[real], behind[real] - 1
        a = anchor[first]
        parts.append((a + at, a - start[first], a - last, hashes[a]))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), none
    anchor, far, near, hashed = (np.concatenate(x) for x in zip(*parts, strict=True))
    return anchor, far, near, hashed, np.searchsorted(offsets, anchor, "right") - 1


def _anchor_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of a block and the number of its documents that have them."""
    *_, hashed, doc = runs(data, offsets)
    order = np.lexsort((doc, hashed))
    hashed, doc = hashed[order], doc[order]
    new = np.ones(len(hashed), bool)
    new[1:] = hashed[1:] != hashed[:-1]
    new_doc = new.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    counts = np.add.reduceat(new_doc.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return hashed[first], counts


def aligned(data: np.ndarray, anchor: np.ndarray, far: np.ndarray, near: np.ndarray) -> np.ndarray:
    """One row of WIDTH bytes per run, the anchor at column REACH; 0 outside of its strings."""
    column = np.arange(WIDTH)[None, :]
    rows = np.empty((len(anchor), WIDTH), np.uint8)
    for i in range(0, len(anchor), 4096):  # positions take eight times the room of the bytes
        a, f, n = (x[i : i + 4096, None] for x in (anchor, far, near))
        known = (column >= REACH - f) & (column < REACH + LENGTH - n)
        rows[i : i + 4096] = np.where(known, data[np.clip(a - REACH + column, 0, len(data) - 1)], 0)
    return rows


def _equal_rows(rows: np.ndarray, far: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of its group, a row of each group) for rows equal in bytes, far and near."""
    whole = np.concatenate([rows, far[:, None].astype(np.uint8), near[:, None].astype(np.uint8)], axis=1)
    whole = np.ascontiguousarray(whole).view(np.dtype((np.void, whole.shape[1])))
    _, first, group = np.unique(whole.ravel(), return_index=True, return_inverse=True)
    return group, first


def _ask(buckets: int, merge_buckets: int):
    """Block and answers -> rows for the merging buckets, and marks already certain."""

    def run(key: tuple, block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = {"bucket": [], "block": [], "payload": []}

        def put(bucket: int, payload: bytes) -> None:
            out["bucket"].append(bucket)
            out["block"].append(key[0])
            out["payload"].append(pack(payload))

        if len(block) and len(told):
            ids, data, offsets = block_content(block.iloc[0])
            anchor, far, near, hashed, doc = runs(data, offsets)
            keys = np.unique(hashed)
            shared = counts_told(keys, told, buckets)[np.searchsorted(keys, hashed)] > 1
            anchor, far, near, hashed, doc = (x[shared] for x in (anchor, far, near, hashed, doc))
        if len(block) and len(told) and len(anchor):
            rows = aligned(data, anchor, far, near)
            group, _ = _equal_rows(rows, far, near)
            owner = ids[doc]
            least = np.full(group.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group, owner)
            # Not the smallest document of this block: removed whatever other blocks have.
            later = owner > least[group]
            mask = (np.int64(1) << (far + 1)) - (np.int64(1) << near)
            put(-1, _marks(anchor[later], mask[later]))
            # Of the others (one document, or rows with one doc_id) every occurrence asks through one row.
            asks = np.flatnonzero(~later)
            order, edges = by_bucket(hashed[asks], merge_buckets)
            asks = asks[order]
            for b in np.flatnonzero(np.diff(edges)):
                these = asks[edges[b] : edges[b + 1]]
                _, which, member = np.unique(group[these], return_index=True, return_inverse=True)
                one = these[which]
                put(
                    int(b),
                    b"".join(
                        [
                            np.array([len(one), len(these)], "<i8").tobytes(),
                            owner[one].astype("<i8").tobytes(),
                            far[one].astype(np.uint8).tobytes(),
                            near[one].astype(np.uint8).tobytes(),
                            member.astype("<i4").tobytes(),
                            anchor[these].astype("<i8").tobytes(),
                            rows[one].tobytes(),
                        ]
                    ),
                )
        give_back()
        return pd.DataFrame(out)

    return run


def _marks(anchor: np.ndarray, mask: np.ndarray) -> bytes:
    return anchor.astype("<i8").tobytes() + mask.astype("<i8").tobytes()


def transform(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Aligned transform of a shard: (symbols, order) by column.

    ``order[c]`` lists the rows by what they hold from column c on, ``symbols[c]`` the bytes
    of column c in the order of what follows it.
    """
    order = np.arange(len(rows), dtype=np.int32)
    symbols = np.empty((WIDTH, len(rows)), np.uint8)
    orders = np.empty((REACH + 1, len(rows)), np.int32)
    by_column = np.ascontiguousarray(rows.T)
    for c in range(WIDTH - 1, -1, -1):
        symbols[c] = by_column[c][order]
        order = order[np.argsort(symbols[c], kind="stable")]
        if c <= REACH:
            orders[c] = order
    return symbols, orders


def smallest_owner(rows: np.ndarray, far: np.ndarray, near: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """By row and distance d: the smallest owner among rows that share the string at d.

    Merges the transforms of the shards by interleave refinement. Entries for distances
    outside near..far hold the row's own owner.
    """
    n = len(rows)
    starts = np.arange(0, n, SHARD_ROWS)
    shards = [transform(rows[s : s + SHARD_ROWS]) for s in starts]
    symbols = np.concatenate([s for s, _ in shards], axis=1)
    orders = np.concatenate([o + s for (_, o), s in zip(shards, starts, strict=True)], axis=1)
    interleave = np.repeat(np.arange(len(starts), dtype=np.uint16), [o.shape[1] for _, o in shards])
    least = np.repeat(owner[None, :], REACH + 1, axis=0)
    prefix = left = None
    for c in range(WIDTH - 1, -1, -1):
        place = np.argsort(interleave, kind="stable")  # where each shard's next entries stand
        merged = np.empty(n, np.uint8)
        merged[place] = symbols[c]
        interleave = interleave[np.argsort(merged, kind="stable")]
        if c > REACH:
            continue
        at = np.empty(n, np.int32)
        at[np.argsort(interleave, kind="stable")] = orders[c]
        d = REACH - c
        if d == 0:
            right = rows[at][:, REACH:]
            differ = right[1:] != right[:-1]
            common = np.where(differ.any(1), differ.argmax(1), LENGTH)
            prefix = np.empty(n, np.int32)  # by row: length it shares with the row before it
            prefix[at] = np.concatenate([[0], common])
            first_order, left = at, np.zeros(n, np.int32)
        else:
            symbol, was = rows[at, c], left[at]
            new = np.ones(n, bool)
            new[1:] = (symbol[1:] != symbol[:-1]) | (was[1:] != was[:-1])
            left = np.empty(n, np.int32)
            left[at] = np.cumsum(new)
        right_group = np.empty(n, np.int32)
        right_group[first_order] = np.cumsum(prefix[first_order] < LENGTH - d)
        here = at[(near[at] <= d) & (far[at] >= d)]
        if len(here):
            new = np.ones(len(here), bool)
            new[1:] = (left[here[1:]] != left[here[:-1]]) | (right_group[here[1:]] != right_group[here[:-1]])
            lowest = np.minimum.reduceat(owner[here], np.flatnonzero(new))
            least[d, here] = lowest[np.cumsum(new) - 1]
    return least


def _merge(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
    """Rows of one bucket from all blocks -> marks by block."""
    if key[0] < 0:
        return table[["block", "payload"]]
    parts = []
    for payload in table["payload"]:
        raw = unpack(payload)
        n, m = np.frombuffer(raw, "<i8", 2)
        at, fields = 16, []
        for kind, count in (("<i8", n), (np.uint8, n), (np.uint8, n), ("<i4", m), ("<i8", m), (np.uint8, n * WIDTH)):
            fields.append(np.frombuffer(raw, kind, count, at))
            at += fields[-1].nbytes
        parts.append(fields)
    owner, far, near = (np.concatenate([p[i] for p in parts]) for i in range(3))
    rows = np.concatenate([p[5] for p in parts]).reshape(-1, WIDTH)
    group, first = _equal_rows(rows, far, near)
    far8, near8 = far[first].astype(np.int16), near[first].astype(np.int16)
    lowest = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(lowest, group, owner)
    least = smallest_owner(rows[first], far8, near8, lowest)
    mask = np.zeros(len(owner), np.int64)
    for d in range(REACH + 1):
        known = (near <= d) & (far >= d)
        mask |= (known & (least[d][group] < owner)).astype(np.int64) << d
    out, at = [], 0
    for fields in parts:
        own = mask[at : at + len(fields[0])][fields[3]]
        at += len(fields[0])
        marked = own != 0
        out.append(pack(_marks(fields[4][marked], own[marked])))
    give_back()
    return pd.DataFrame({"block": table["block"], "payload": out})


def covered(size: int, marks: list[bytes]) -> np.ndarray:
    """Bytes that a marked string covers."""
    starts = np.zeros(size + 1, np.int32)
    for payload in marks:
        anchor, mask = np.frombuffer(unpack(payload), "<i8").reshape(2, -1)
        for d in range(REACH + 1):
            starts[anchor[(mask >> d) & 1 == 1] - d] = 1
    before = np.concatenate([[0], np.cumsum(starts[:size])])
    return before[1:] > before[np.maximum(np.arange(size) + 1 - LENGTH, 0)]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(block: pa.Table, marks: pa.Table) -> pa.Table:
    """A block and the marks for it -> a row per document, further columns included."""
    row = block.to_pylist()[0]
    ids, data, offsets = block_content(row)
    gone = covered(len(data), marks.column("payload").to_pylist())
    spans, kept = [], []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        edges = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        spans.append([{"start": int(x), "end": int(y)} for x, y in edges])
        kept.append(data[a:b][~gone[a:b]].tobytes())
    out = {
        "doc_id": pa.array(ids, mask=ids == NO_ID),
        "n_bytes": pa.array(np.diff(offsets)),
        "spans": pa.array(spans, _SPANS),
        "kept": pa.array(kept, pa.binary()),
    }
    more = carried(row)
    give_back()
    return pa.table(out | {c: more.column(c) for c in more.column_names})


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, spans, kept, and the columns named in ``carry``.

    A byte is removed if a string of LENGTH bytes that covers it also starts in a document
    with a smaller doc_id, judged on the input. ``spans`` are the maximal removed runs of
    the text's UTF-8 bytes, ``kept`` the bytes that remain (which may begin or end inside a
    character). Matches never cross documents; shorter texts are kept whole.

    NULL and empty texts have 0 bytes. A NULL doc_id is smaller than any other. Rows that
    share a doc_id are documents of their own, none smaller than the other, so they do not
    remove each other. Columns that are not named are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *carry)
    blocks = make_blocks(rows)
    buckets, merge_buckets = bucket_count(blocks), bucket_count(blocks, MERGE_BYTES)
    told = document_counts(blocks, _anchor_features, buckets)
    by_block = blocks.drop("carried").groupBy("block")
    asked = by_block.cogroup(told.groupBy("block")).applyInPandas(
        _ask(buckets, merge_buckets), "bucket int, block long, payload binary"
    )
    # What is certain within a block has no bucket to go to; it is dealt by block instead.
    deal = F.when(F.col("bucket") < 0, -1 - F.col("block")).otherwise(F.col("bucket").cast("long"))
    marks = asked.select(deal.alias("bucket"), "block", "payload").groupBy("bucket").applyInPandas(
        _merge, "block long, payload binary"
    )
    result = StructType.fromDDL("doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    for c in carry:
        result = result.add(rows.schema[c])
    return blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_cut, result)


def _readable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x.decode("utf-8", "ignore") for x in batch.column("text").to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def shorten(docs: DataFrame) -> DataFrame:
    """``docs`` (with doc_id and text), all its columns, without the repeats in its texts.

    What is left of a character cut in two is dropped; ``n_chars``, if there, is counted anew.
    A text that is removed entirely stays as an empty one. Other columns may have any name.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]
    rest = docs.select("doc_id", "text", F.struct(F.lit(True).alias("there"), *columns).alias("rest"))
    cut = remove_repeats(rest, carry=("rest",)).select("doc_id", F.col("kept").alias("text"), "rest")
    out = cut.mapInArrow(_readable, StructType([f if f.name != "text" else docs.schema["text"] for f in cut.schema]))
    back = {c: F.col(f"rest.c{i}") for i, c in enumerate(others)} | {c: F.col(c) for c in ("doc_id", "text")}
    if "n_chars" in others:
        back["n_chars"] = F.length("text")
    return out.select(*[back[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = remove_repeats(read_table(spark, sf_dir, "documents"))
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return result.select(
        "doc_id",
        "n_bytes",
        length.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
