"""Cheapest repair of conversations by dynamic programming on a grammar.

A conversation should read ``s?(ua)+`` by the initials of its roles, or be empty. Rows may
be kept, given the role user or assistant, deleted, and empty rows may be inserted; blank and
repeated rows must go. The cheapest edits are a shortest path, and what a stretch of rows
does to the state of the reading (nothing yet, after system, after user, after assistant) is
a min-plus matrix of costs and edits. Matrices of neighbouring stretches multiply.

* Rows are put in order by range partitions, so one conversation may span many tasks, and
  numbered; 1024 neighbours of a conversation make a segment. A row is one of nine symbols
  (initial of its role, complete or cut off; or must go), a segment a word of symbols.
* Equal words are solved once, whatever conversation they stand in. Distinct words are dealt
  to bounded buckets; in each, Re-Pair names the most frequent pair of symbols by a new
  symbol, again and again. Every rule has one matrix, the product of its two sides, whose
  audits are ropes: they point into the sides' audits and are spelled out only to break a
  tie or at the end.
* A pass over the segments of a conversation, in order, multiplies their matrices and walks
  back through the cheapest choice, which gives each segment its part of the audit.
* A last pass over the rows, in order, applies the edits.

Comparing (cost, audit) survives products: of two audits for the same rows and states, none
begins the other, as both have one letter other than I for each row and end with one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlake.llm.common import give_back, read_table, write_and_read

REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: Rows in a segment (a power of two), and symbols of distinct words in a bucket of the grammar.
SEGMENT_BITS, BUCKET_SYMBOLS = 10, 1 << 16
#: A pair that stands so often gets a rule; audits up to this length are spelled out at once.
LEAST_PAIRS, SPELLED = 8, 64

MUST_GO = "d"
#: Initials of roles, complete rows in small letters, cut off ones in capitals; o is any other role.
SYMBOLS = MUST_GO + "suao" + "SUAO"

_SPACE = " \t\n\x0b\f\r"
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. 0 and 3 may end.
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: Rows to insert to get from a state to another.
_INSERTS = {(0, 2): 1, (0, 3): 2, (1, 2): 1, (1, 3): 2, (2, 3): 1, (3, 2): 1, **{(i, i): 0 for i in range(4)}}

Rope = str | tuple  # text, or (rope, rope)
Matrix = list[dict[int, tuple[int, Rope]]]  # state before -> state after -> cost, audit


# --- ropes and matrices ----------------------------------------------------------


def _leaves(rope: Rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            if top:
                yield top
        else:
            stack.extend((top[1], top[0]))


def spell(rope: Rope) -> str:
    return "".join(_leaves(rope))


def _less(a: Rope, b: Rope) -> bool:
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    left, right, x, y = _leaves(a), _leaves(b), "", ""
    while True:
        x, y = x or next(left, ""), y or next(right, "")
        size = min(len(x), len(y))
        if size == 0 or x[:size] != y[:size]:
            return x[:size] < y[:size] if size else len(x) < len(y)
        x, y = x[size:], y[size:]


def _better(new: tuple[int, Rope], old: tuple[int, Rope] | None) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and _less(new[1], old[1]))


def _concat(a: Rope, b: Rope) -> Rope:
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= SPELLED:
        return a + b
    return (a, b)


def product(first: Matrix, second: Matrix) -> Matrix:
    out: Matrix = []
    for row in first:
        best: dict[int, tuple[int, Rope]] = {}
        for middle, (cost, audit) in row.items():
            for after, (more, rest) in second[middle].items():
                old = best.get(after)
                if old is None or cost + more <= old[0]:
                    new = (cost + more, _concat(audit, rest))
                    if _better(new, old):
                        best[after] = new
        out.append(best)
    return out


def terminal(symbol: str) -> Matrix:
    """What one row does: rows inserted before it, then its own edit."""
    edits = [(DELETE, "D", None)]
    if symbol != MUST_GO:
        late = CUT_OFF * symbol.isupper()
        edits.append((late, "K", symbol.lower()))
        edits += [(REROLE + late, "R", initial) for initial in "ua"]
    out: Matrix = [{} for _ in range(4)]
    for (before, middle), inserted in _INSERTS.items():
        for cost, letter, initial in edits:
            after = middle if initial is None else _STEP.get((middle, initial))
            new = (INSERT * inserted + cost, "I" * inserted + letter)
            if after is not None and _better(new, out[before].get(after)):
                out[before][after] = new
    return out


# --- the grammar -----------------------------------------------------------------


def compress(words: list[str], least: int = LEAST_PAIRS) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Re-Pair over all words: rules (rule i has number len(SYMBOLS) + i), and each word in them."""
    symbol = np.full(256, -1, np.int64)
    symbol[[ord(c) for c in SYMBOLS]] = range(len(SYMBOLS))
    text = symbol[np.frombuffer("\n".join(words).encode(), np.uint8)]
    rules: list[tuple[int, int]] = []
    while len(text) > 1:
        width = len(SYMBOLS) + len(rules)
        pairs = np.where((text[:-1] >= 0) & (text[1:] >= 0), text[:-1] * width + text[1:], -1)
        kinds, counts = np.unique(pairs[pairs >= 0], return_counts=True)
        if not len(kinds) or counts.max() < max(least, 2):
            break
        pair = kinds[counts.argmax()]
        at = np.flatnonzero(pairs == pair)
        if pair // width == pair % width:  # in a run of equal symbols every second pair
            begins = np.concatenate([[True], np.diff(at) > 1])
            at = at[(at - at[begins][np.cumsum(begins) - 1]) % 2 == 0]
        text[at] = width
        text = np.delete(text, at + 1)
        rules.append((int(pair // width), int(pair % width)))
    ends = np.flatnonzero(text < 0)
    return rules, [part[part >= 0].tolist() for part in np.split(text, ends)]


def solve(words: list[str], least: int = LEAST_PAIRS) -> list[Matrix]:
    """A matrix per word, through one matrix per rule of their common grammar."""
    rules, coded = compress(words, least)
    known = [terminal(symbol) for symbol in SYMBOLS]
    for left, right in rules:
        known.append(product(known[left], known[right]))
    out = []
    for word in coded:
        total = known[word[0]]
        for symbol in word[1:]:
            total = product(total, known[symbol])
        out.append(total)
    return out


_ENTRIES = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _solve_bucket(bucket: pa.Table) -> pa.Table:
    words = bucket.column("word").to_pylist()
    entries = [
        [
            {"before": i, "after": j, "cost": cost, "audit": spell(audit)}
            for i, row in enumerate(matrix)
            for j, (cost, audit) in row.items()
        ]
        for matrix in solve(words)
    ]
    return pa.table({"word": bucket.column("word"), "matrix": pa.array(entries, _ENTRIES)})


# --- along a conversation --------------------------------------------------------


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order of (conv_id, segment) -> per segment its audit; per conversation, on the last, the cost."""
    conv, vector, segments, began = None, None, [], False

    def finish():
        cost, (way, inserted) = _end(vector)
        audits = []
        while way is not None:
            way, own = way
            audits.append(own)
        audits.reverse()
        audits[-1] += inserted
        return [conv] * len(segments), segments, audits, [None] * (len(segments) - 1) + [cost]

    def batch_of(done):
        columns = [list(chain.from_iterable(d[i] for d in done)) for i in range(4)]
        kinds = (conv_type, pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", "segment", "audit", "cost"]
        )

    conv_type = pa.int64()
    for batch in batches:
        conv_type, done = batch.schema.field("conv_id").type, []
        rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "matrix")), strict=True)
        for key, segment, entries in rows:
            if not began or key != conv:
                if began:
                    done.append(finish())
                conv, vector, segments, began = key, {0: (0, None)}, [], True
            following: dict[int, tuple[int, Rope]] = {}
            for entry in entries:
                if entry["before"] in vector:
                    cost, so_far = vector[entry["before"]]
                    new, old = (cost + entry["cost"], (so_far, entry["audit"])), following.get(entry["after"])
                    if _better_way(new, old):
                        following[entry["after"]] = new
            vector = following
            segments.append(segment)
        if done:
            yield batch_of(done)
    if began:
        yield batch_of([finish()])
    give_back()


def _less_way(a: tuple, b: tuple) -> bool:
    """Compare audits kept as (earlier segments, own): from the last segment in which they differ backwards."""
    left, right = [], []
    while a is not b:  # both have as many segments; what they share is the same object
        left.append(a[1])
        right.append(b[1])
        a, b = a[0], b[0]
    return "".join(reversed(left)) < "".join(reversed(right))


def _better_way(new: tuple, old: tuple | None) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and _less_way(new[1], old[1]))


def _end(vector: dict[int, tuple]) -> tuple:
    """The cheapest way to an end: (cost, (way so far, last inserts))."""
    best = None
    for state, (cost, way) in sorted(vector.items()):
        more = 0 if state in (0, 3) else _INSERTS[state, 3]
        new = (cost + INSERT * more, (way, "I" * more))
        if _better_way(new, best):
            best = new
    return best


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and audits in order of (conv_id, segment, place) -> the repaired rows."""
    conv, began, audit, at, state, place = None, False, "", 0, 0, 0
    for batch in batches:
        out: list[tuple] = []

        def put(letter, role, text):
            nonlocal state, place
            if letter != "K":
                role = "assistant" if state == 2 else "user"
            state = _STEP[state, role[:1]]
            out.append((conv, place, letter, role, text))
            place += 1

        def insert():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("I", None, "")
                at += 1

        names = ("conv_id", "role", "text", "n", "audit")
        for key, role, text, n, letters in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if not began or key != conv:
                conv, began, state, place = key, True, 0, 0
            if letters is not None:
                audit, at = letters, 0
                continue
            for _ in range(n):
                insert()
                if audit[at] != "D":
                    put(audit[at], role, text)
                at += 1
            if at + 2 >= len(audit):  # what may be left are rows inserted at the end
                if audit[at:].strip("I") == "":
                    insert()
        if out:
            columns = list(zip(*out, strict=True))
            kinds = (batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["conv_id", "place", "edit", "role", "text"],
            )
    give_back()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, running = None, None
    for batch in batches:
        done = []
        for key, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
            if place == 0:
                if running:
                    done.append((conv, running.hexdigest()))
                conv, running = key, hashlib.sha256()
            running.update(f"{role}:{text}".encode() if place == 0 else f"\n{role}:{text}".encode())
        if done:
            yield _digests(done, batch.schema.field("conv_id").type)
        last_type = batch.schema.field("conv_id").type
    if running:
        yield _digests([(conv, running.hexdigest())], last_type)


def _digests(done: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    keys, digests = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, conv_type), pa.array(digests)], names=["conv_id", "sha256"])


# --- the operator ----------------------------------------------------------------


def _placed(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number n, in order (``at``), with their symbols."""
    equal = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    said = F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256)
    equal = write_and_read(equal.withColumn("said", said), "rows")
    met = (
        equal.groupBy("conv_id", "said")
        .agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first"), F.count("*").alias("turns"))
        .filter("turns > 1")
        .select(F.col("conv_id").alias("c"), F.col("said").alias("s"), F.col("first.turn").alias("first_turn"))
    )
    again = F.col("s").isNotNull() & ~F.col("first_turn").eqNullSafe(F.col("turn"))
    bare = F.rtrim("text", F.lit(_SPACE))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.substring(bare, -1, 1).isin(".", "!", "?"), known).otherwise(F.upper(known))
    marked = (
        equal.join(met, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
        .withColumn("blank", bare == "")
        .withColumn("gone", F.col("blank") | again)
        .withColumn("word", F.when(F.col("gone"), F.lit(MUST_GO)).otherwise(symbol))
        .withColumn("word", F.concat("word", F.expr(f"repeat('{MUST_GO}', cast(n - 1 as int))")))
        .select("conv_id", "turn", "role", "text", "n", "blank", "gone", "word", initial.alias("initial"))
    )
    order = (F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"))
    ranged = marked.repartitionByRange(*order, F.substring("text", 1, 100).asc())
    ordered = ranged.sortWithinPartitions(*order, F.asc("text"))
    return write_and_read(ordered.withColumn("at", F.monotonically_increasing_id()), "placed")


def _segments(placed: DataFrame) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("at", "word", "initial")))
    bad = "concat(rows[i - 1].initial, rows[i].initial) not in ('su', 'ua', 'au')"
    return (
        placed.groupBy("conv_id", F.shiftright("at", SEGMENT_BITS).alias("segment"))
        .agg(
            rows.alias("rows"),  # at most 2 ** SEGMENT_BITS
            F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
            F.sum(F.when(F.col("blank"), 0).when(F.col("gone"), F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
            F.sum(F.when(F.substring("word", 1, 1).isin(*"SUAO"), 1).otherwise(0)).alias("truncated"),
            F.sum(F.col("n") - 1).alias("repeats"),
        )
        .withColumn("word", F.expr("array_join(transform(rows, r -> r.word), '')"))
        .withColumn("inner_bad", F.expr(f"if(size(rows) < 2, 0, size(filter(sequence(1, size(rows) - 1), i -> {bad})))"))
        .withColumn("illegal", (F.col("repeats") + F.col("inner_bad")).cast("long"))
        .withColumn("first", F.expr("rows[0].initial"))
        .withColumn("last", F.expr("rows[size(rows) - 1].initial"))
        .drop("rows", "repeats", "inner_bad")
    )


def _solved(segments: DataFrame) -> DataFrame:
    words = write_and_read(segments.select("word").distinct(), "words")
    symbols = words.agg(F.sum(F.length("word"))).first()[0] or 0
    buckets = int(max(1, symbols // BUCKET_SYMBOLS))
    dealt = words.groupBy(F.pmod(F.xxhash64("word"), F.lit(buckets)).alias("bucket"))
    entries = "matrix array<struct<before:int,after:int,cost:long,audit:string>>"
    return write_and_read(dealt.applyInArrow(_solve_bucket, f"word string, {entries}"), "matrices")


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(per conversation what was found and done, the repaired rows in order).

    The first has conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit; the
    second conv_id, place, edit (K, R or I), role, text, ordered by place within a partition,
    and a conversation lies in one partition.

    Rows are ordered by turn, NULL first, then role and text; equal rows are neighbours. A
    NULL role or text counts as one space, a NULL conv_id is a conversation of its own. A
    role that begins with none of s, u, a (an empty one too) must be changed or go. An empty
    table gives none. Texts are read whole; other columns are ignored, whatever their names.
    Equally cheap edits are decided by the audit first in ASCII order, which is unique.
    """
    plain = rows.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    key = plain.schema["conv_id"].dataType.simpleString()
    placed = _placed(plain)
    segments = write_and_read(_segments(placed), "segments")
    solved = segments.select("conv_id", "segment", "word").join(_solved(segments), "word")
    ordered = solved.repartition("conv_id").sortWithinPartitions("conv_id", "segment").select("conv_id", "segment", "matrix")
    audits = write_and_read(
        ordered.mapInArrow(_along, f"conv_id {key}, segment long, audit string, cost long"), "audits"
    )
    turns = placed.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")
    )
    following = Window.partitionBy("conv_id").orderBy("segment")
    seam = F.concat(F.lag("last").over(following), F.col("first"))
    seams = segments.withColumn("seam", F.when(~seam.isin("su", "ua", "au"), 1).otherwise(0))
    counted = seams.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.sum("illegal") + F.sum("seam")).alias("illegal"),
    )
    done = audits.groupBy("conv_id").agg(
        F.max("cost").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", "audit"))), lambda s: s["audit"]), "").alias("audit"),
    )

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("conv_id", "same_id")
        return left.join(right, F.col("conv_id").eqNullSafe(F.col("same_id")), "left").drop("same_id")

    found = beside(beside(turns, counted), done).select(
        "conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
        "illegal", "cost", "audit",
    )
    stream = placed.select(
        "conv_id", F.shiftright("at", SEGMENT_BITS).alias("segment"), "at", "role", "text", "n",
        F.lit(None).cast("string").alias("audit"),
    ).unionByName(
        audits.select("conv_id", "segment", F.lit(-1).cast("long").alias("at"), "audit"), allowMissingColumns=True
    )
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "at")
    repaired = stream.select("conv_id", "role", "text", "n", "audit").mapInArrow(
        _apply, f"conv_id {key}, place long, edit string, role string, text string"
    )
    return found, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, sha256 of ``role:text`` lines joined by line feeds; ``repaired`` as it comes from ``repair``."""
    key = repaired.schema["conv_id"].dataType.simpleString()
    return repaired.select("conv_id", "place", "role", "text").mapInArrow(_digest, f"conv_id {key}, sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults, chosen by crc32 of ``conv_id:turn`` modulo 20; NULLs become one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    chosen = rows.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(key) % 20).alias("fault"),
    )
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return chosen.filter("fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    found, repaired = repair(damage(rows))
    ids = rows.select("conv_id").distinct()
    found, hashed = found.withColumnRenamed("conv_id", "found_id"), digests(repaired).withColumnRenamed("conv_id", "hashed_id")
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").join(
        hashed, F.col("conv_id").eqNullSafe(F.col("hashed_id")), "left"
    )
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
