"""Phrase collocations by best-first branch and bound.

Texts are cut into pieces and words; phrases of two to four words that stand often enough
are scored by how much of their parts' occurrences they make up. What a prefix can still
grow into is bounded by its own count: a phrase q that begins with p and the word w has
a(q) <= f(p), its first part at the cut behind w is w, and its rest is at least as frequent
as q, so score(q) <= 2,000,000 f(p) / (f(w) + f(p)). The bound falls along a branch.

1. Words and pairs are counted over everything. ``blocks.make_blocks`` packs the texts;
   each block sends a hash of each distinct word and pair to a bucket once and is told
   which reach the least count, so the long tail never travels as text. The others are
   counted exactly, by (language, phrase).
2. A threshold per language is taken from a histogram of the pairs' scores. The frontier
   are prefixes whose bound reaches it; they are grown by a word, then by another. Phrases
   that reach the threshold themselves are also grown to both sides by one word, which
   tells whether a longer phrase covers them: a cover by two words more implies one by one
   word more, as that is at least as frequent.
3. If a language has fewer survivors at its threshold than asked for, the threshold falls
   and only what lies between the old and the new one is grown. At threshold 0 all is grown.

A pass over the texts finds the frontier by bitmaps of a fixed size (``BITMAP_BITS``) that
are sent to the tasks. They hold hashes, so they may let further phrases in, whose counts
are then exact too, but never keep one out; nothing depends on how full they are but speed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlake.llm import blocks as packed
from rosterlake.llm.common import give_back, read_table, text_batches, write_and_read

LEAST, LONGEST, KEEP, SCALE = 30, 4, 2000, 2_000_000
#: A phrase goes if a longer one has at least so many per cent of its occurrences.
COVER_PERCENT = 80
#: Text a task works on at a time, and bits of a frontier's bitmap.
PART_BYTES, BITMAP_BITS = 4 << 20, 1 << 25
#: Scores of a histogram's bin; the first threshold leaves about FIRST times KEEP pairs.
BIN, FIRST, WIDEN = 1000, 2, 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 belongs to a word, 1 separates words, 2 ends a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = 2

_COUNTS = "lang string, size int, phrase string, f long"


class Words:
    """The words of some texts: per word its number, its piece; per number language, word and hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: pa.Array) -> None:
        data = _LOWER[data]
        kind = _KIND[data]
        first = np.zeros(len(data) + 1, bool)  # where a text begins
        first[offsets] = True
        inside = kind == 0
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1]
        ends[:-1] &= ~inside[1:] | first[1:-1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.piece = np.cumsum((kind == 2) | first[:-1], dtype=np.int32)[starts]
        edges = np.empty(2 * len(starts), np.int64)
        edges[0::2], edges[1::2] = starts, stops
        if len(starts):
            both = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]
            )
            coded = both.take(pa.array(np.arange(0, len(edges) - 1, 2))).dictionary_encode()
            said, spelled = coded.indices.to_numpy(), coded.dictionary
        else:
            said, spelled = np.zeros(0, np.int64), pa.array([], pa.large_binary())
        langs = langs.fill_null("und").dictionary_encode()
        spoken = langs.indices.to_numpy()[np.searchsorted(offsets, starts, "right") - 1].astype(np.int64)
        keys, self.number = _dense(spoken * max(len(spelled), 1) + said, len(langs.dictionary) * len(spelled))
        of_lang, of_word = np.divmod(keys, max(len(spelled), 1))
        self.lang = langs.dictionary.take(pa.array(of_lang))
        self.spelled = spelled.take(pa.array(of_word))
        self.hash = _hashes(spelled.to_pylist())[of_word]
        self.lang_hash = _hashes(langs.dictionary.to_pylist())[of_lang]

    def starts(self, size: int) -> np.ndarray:
        """Whether a phrase of ``size`` words begins at each word."""
        begins = np.zeros(len(self.number), bool)
        if size <= len(self.number):
            begins[: len(begins) - size + 1] = self.piece[: len(self.piece) - size + 1] == self.piece[size - 1 :]
        return begins

    def distinct(self, size: int, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct phrases that begin ``where`` (rows of word numbers), and how often each does."""
        at, most = np.flatnonzero(where), max(len(self.hash), 1)
        key = self.number[at].astype(np.int64)
        if size < 3:  # the key still tells its words
            if size == 2:
                key = key * most + self.number[at + 1]
            key.sort()
            edges = np.flatnonzero(np.concatenate([key[:1] == key[:1], key[1:] != key[:-1]]))
            one = key[edges]
            grams = np.stack(np.divmod(one, most), axis=1) if size == 2 else one[:, None]
            return grams, np.diff(np.append(edges, len(key)))
        for i in range(1, size):
            if i > 1:
                _, key = np.unique(key, return_inverse=True)  # small again: the product fits in 64 bits
            key = key * most + self.number[at + i]
        _, one, counts = np.unique(key, return_index=True, return_counts=True)
        return self.number[at[one][:, None] + np.arange(size)], counts

    def hashed(self, grams: np.ndarray) -> np.ndarray:
        total = self.lang_hash[grams[:, 0]]
        for i in range(grams.shape[1]):
            total = _append(total, self.hash[grams[:, i]])
        return total

    def hashes_at(self, size: int) -> np.ndarray:
        """Per word the hash of the phrase that begins there; of use only where one does."""
        total, known = self.lang_hash[self.number], self.hash[self.number]
        for i in range(size):
            total = _append(total, np.concatenate([known[i:], np.zeros(min(i, len(known)), np.uint64)]))
        return total

    def rows(self, grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        parts = [self.spelled.take(pa.array(grams[:, i])) for i in range(grams.shape[1])]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if len(parts) > 1 else parts[0]
        return _rows(self.lang.take(pa.array(grams[:, 0])), grams.shape[1], phrase.cast(pa.string()), counts)


def _dense(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, all below ``most``, in order, and for each key its place among them."""
    if most > 8 * len(keys):
        return np.unique(keys, return_inverse=True)
    there = np.zeros(most, bool)
    there[keys] = True
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[keys]


def _rows(lang: pa.Array, size: int, phrase: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    sizes = pa.array(np.full(len(counts), size, np.int32))
    return pa.RecordBatch.from_arrays(
        [lang.cast(pa.string()), sizes, phrase, pa.array(counts, pa.int64())], names=["lang", "size", "phrase", "f"]
    )


def _hashes(words: list) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))


def _append(total: np.ndarray, word: np.ndarray) -> np.ndarray:
    return ((total << np.uint64(17)) | (total >> np.uint64(47))) ^ word


def phrase_hash(lang: Column, phrase: Column) -> Column:
    """The same hash of a language and a phrase, as an expression."""
    return F.aggregate(
        F.split(phrase, " "),
        F.xxhash64(lang),
        lambda total, word: F.shiftleft(total, 17).bitwiseOR(F.shiftrightunsigned(total, 47)).bitwiseXOR(F.xxhash64(word)),
    )


# --- words and pairs -------------------------------------------------------------


def _block_words(row) -> Words:
    _, data, offsets = packed.block_content(row)
    return Words(data, offsets, packed.carried(row).column("lang").combine_chunks())


def _first_two(words: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(phrases, counts, hashes) of the distinct words, then of the distinct pairs."""
    return [(g, n, words.hashed(g)) for g, n in (words.distinct(size, words.starts(size)) for size in (1, 2))]


def _send(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = _first_two(_block_words(row))
                keys = np.concatenate([h for _, _, h in levels])
                counts = np.minimum(np.concatenate([n for _, n, _ in levels]), packed.MOST_COUNTED).astype(np.uint8)
                order, edges = packed.by_bucket(keys, buckets)
                low, counts = (keys[order] & np.uint64(0xFFFFFFFF)).astype("<u4"), counts[order]
                filled = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(filled.astype(np.int32)),
                        pa.array(np.full(len(filled), row["block"], np.int64)),
                        pa.array([low[edges[i] : edges[i + 1]].tobytes() for i in filled], pa.binary()),
                        pa.array([counts[edges[i] : edges[i + 1]].tobytes() for i in filled], pa.binary()),
                    ],
                    names=["bucket", "block", "keys", "counts"],
                )
        give_back()

    return run


def _emit(buckets: int, least: int):
    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        words = _block_words(block.to_pylist()[0])
        levels = _first_two(words)
        keys = np.concatenate([h for _, _, h in levels])
        often = packed.counts_told(keys, told.to_pandas(), buckets) >= least if len(keys) else []
        parts, at = [], 0
        for grams, counts, _ in levels:
            mine = often[at : at + len(grams)]
            at += len(grams)
            parts.append(words.rows(grams[mine], counts[mine]) if len(mine) else None)
        of_lang = pc.value_counts(words.lang.take(pa.array(words.number))).to_pylist()  # n: all words
        total = pa.array([x["values"] for x in of_lang], pa.string())
        parts.append(_rows(total, 0, pa.array([""] * len(total), pa.string()), np.array([x["counts"] for x in of_lang], np.int64)))
        return pa.Table.from_batches([p for p in parts if p is not None])

    return run


def count_words_and_pairs(rows: DataFrame, least: int) -> DataFrame:
    """Exact counts of words and pairs that stand ``least`` times; size 0 holds each language's words."""
    blocks = packed.make_blocks(rows.select(F.lit(0).alias("doc_id"), "text", "lang"), PART_BYTES)
    buckets = packed.bucket_count(blocks)
    sent = blocks.mapInArrow(_send(buckets), "bucket int, block long, keys binary, counts binary")
    told = sent.groupBy("bucket").applyInPandas(packed._count, "block long, bucket int, told binary")
    emitted = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_emit(buckets, least), _COUNTS)
    return _summed(emitted, least, "pairs")


def _summed(emitted: DataFrame, least: int, label: str) -> DataFrame:
    whole = emitted.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return write_and_read(whole.filter((F.col("f") >= least) | (F.col("size") == 0)), f"counted_{label}")


# --- growing phrases -------------------------------------------------------------


def bitmap(phrases: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bits set at the hashes of ``phrases(lang, phrase)``: as many bytes as asked for, whatever their number."""
    slot = F.pmod(phrase_hash(F.col("lang"), F.col("phrase")), F.lit(bits))
    words = (
        phrases.select(slot.alias("slot"))
        .groupBy((F.shiftright("slot", 5)).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 31 as int)))").alias("bits"))
        .toPandas()
    )
    table = np.zeros(bits // 32, np.uint32)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return table


def _has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(len(table) * 32 - 1)
    return (table[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0


def _ahead(flags: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([flags[by:], np.zeros(min(by, len(flags)), bool)])


def _grow(size: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            for part, data, offsets in text_batches(batch, "text", PART_BYTES):
                words = Words(data, offsets, part.column("lang"))
                where = words.starts(size)
                pair = _has(tables["pairs"], words.hashes_at(2))
                for i in range(size - 1):
                    where &= _ahead(pair, i)
                if "exact" in tables:
                    where &= _has(tables["exact"], words.hashes_at(size))
                else:
                    shorter = words.hashes_at(size - 1)
                    where &= _has(tables["prefix"], shorter) | _ahead(_has(tables["suffix"], shorter), 1)
                yield words.rows(*words.distinct(size, where))
        give_back()

    return run


def _pass(rows: DataFrame, size: int, least: int, **tables: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(tables)
    counted = _summed(rows.select("text", "lang").mapInArrow(_grow(size, shared), _COUNTS), least, f"size{size}")
    shared.destroy()
    return counted


def _words(phrase: str, begin: str, length: str) -> Column:
    return F.expr(f"array_join(slice(split({phrase}, ' '), {begin}, {length}), ' ')")


def _share(part: Column, whole: Column) -> Column:
    """floor(SCALE * part / whole), exact beyond 64 bits."""
    wide = "decimal(20,0)"
    return F.call_function("div", part.cast(wide) * F.lit(SCALE).cast("decimal(8,0)"), whole.cast(wide))


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """``phrases(lang, size, phrase, f)`` with l, r, score of the lowest cut, bound, and whether that is exact.

    A part without a count is taken to be as frequent as the phrase, which it is at least;
    the score is then an upper bound.
    """
    cuts = phrases.select("*", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.withColumn("head", _words("phrase", "1", "k")).withColumn("tail", _words("phrase", "k + 1", "size - k"))
    known = counts.filter("size > 0").select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("f").alias("times"))
    for side, part in (("l", "head"), ("r", "tail")):
        met = known.toDF(f"{side}_of", f"{side}_part", f"{side}_times")
        cuts = cuts.join(met, (F.col("lang") == F.col(f"{side}_of")) & (F.col(part) == F.col(f"{side}_part")), "left")
        cuts = cuts.withColumn(side, F.coalesce(f"{side}_times", "f"))
    cuts = cuts.withColumn("score", _share(F.col("f"), F.col("l") + F.col("r")))
    lowest = cuts.groupBy("lang", "size", "phrase", "f").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"),
        F.max(F.when(F.col("k") == 1, F.col("l"))).alias("first"),
        F.bool_and(F.col("l_times").isNotNull() & F.col("r_times").isNotNull()).alias("exact"),
    )
    return lowest.select(
        "lang", "size", "phrase", "f", "cut.l", "cut.r", "cut.score", "exact",
        _share(F.col("f"), F.col("first") + F.col("f")).alias("bound"),
    )


def thresholds(pairs: DataFrame, wanted: int) -> DataFrame:
    """(lang, low): the lower edge of the bin at which the ``wanted`` best pairs of a language are reached, or 0."""
    bins = pairs.groupBy("lang", F.expr(f"score div {BIN}").alias("bin")).agg(F.count("*").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("bin"))  # at most SCALE / BIN rows a language
    reached = bins.withColumn("above", F.sum("n").over(best)).groupBy("lang")
    return reached.agg(F.coalesce(F.max(F.when(F.col("above") >= wanted, F.col("bin"))), F.lit(0)).alias("bin")).select(
        "lang", (F.col("bin") * BIN).alias("low")
    )


def _between(column: str) -> Column:
    return (F.col(column) >= F.col("low")) & (F.col(column) < F.col("high"))


def _uncovered(best: DataFrame, longer: DataFrame) -> DataFrame:
    """Phrases of ``best`` that no phrase of ``longer`` holds in COVER_PERCENT of their places."""
    inner = F.explode(F.array(_words("phrase", "1", "size - 1"), _words("phrase", "2", "size - 1")))
    most = (
        longer.filter("size > 2")
        .select(F.col("lang").alias("of"), inner.alias("part"), "f")
        .groupBy("of", "part")
        .agg(F.max("f").alias("longest"))
    )
    joined = best.join(most, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")), "left")
    wide = "decimal(20,0)"
    covered = F.col("longest").cast(wide) * 100 >= F.col("f").cast(wide) * COVER_PERCENT
    return joined.filter(~F.coalesce(covered, F.lit(False))).drop("of", "part", "longest")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", keep: int = KEEP, least: int = LEAST) -> DataFrame:
    """The ``keep`` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lowered; pieces end at ``.,;:!?`` and line breaks, words at blanks and tabs. a
    is how often the phrase stands in pieces (overlaps count), l and r how often its two
    parts at the cut with the lowest score (ties: the shorter first part), n the number
    of all words of the language. Ties of score go to the larger a, then to the phrase first in byte
    order, so equal inputs give equal ranks.

    A NULL language is 'und'; NULL, empty and blank texts hold nothing; repeated rows count
    each time. Texts are read whole; a language without phrases, and an empty table, give
    no rows. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    counts = count_words_and_pairs(rows, least)
    pairs = write_and_read(scored(counts.filter("size = 2"), counts), "pairs_scored")
    often = bitmap(counts.filter("size = 2"))
    empty = counts.limit(0)
    grown = {3: empty, 4: empty}
    wanted = keep * FIRST
    spans = write_and_read(thresholds(pairs, wanted).withColumn("high", F.lit(2 * SCALE).cast("long")), "thresholds")
    while True:
        known = pairs
        for size in (3, LONGEST):
            span = known.join(spans, "lang")
            reach = span.filter(_between("score"))
            ahead = span.filter(_between("bound")).select("lang", "phrase").union(reach.select("lang", "phrase"))
            found = _pass(rows, size, least, pairs=often, prefix=bitmap(ahead), suffix=bitmap(reach.select("lang", "phrase")))
            grown[size] = grown[size].union(found).dropDuplicates(["lang", "phrase"])
            counts = counts.union(found).dropDuplicates(["lang", "phrase", "size"])
            known = write_and_read(scored(grown[size], counts), f"scored{size}")
            if size == LONGEST:
                open_ends = known.join(spans, "lang").filter("not exact and score >= low")
                tails = open_ends.select("lang", _words("phrase", "2", "size - 1").alias("phrase")).distinct()
                if not tails.isEmpty():
                    found = _pass(rows, size - 1, least, pairs=often, exact=bitmap(tails))
                    counts = counts.union(found).dropDuplicates(["lang", "phrase", "size"])
                    known = write_and_read(scored(grown[size], counts), f"settled{size}")
            if size == 3:
                triples = known
        longer = grown[3].union(grown[4])
        reached = pairs.union(triples).union(known).join(spans, "lang").filter("exact and score >= low")
        best = write_and_read(_uncovered(reached, longer), "survivors")
        missing = spans.join(best.groupBy("lang").agg(F.count("*").alias("n")), "lang", "left")
        missing = missing.filter((F.col("low") > 0) & (F.coalesce("n", F.lit(0)) < keep)).select("lang", F.col("low").alias("high"))
        if missing.isEmpty():
            break
        wanted *= WIDEN
        lower = thresholds(pairs, wanted).join(missing, "lang").select("lang", "low", "high")
        rest = spans.join(missing.select("lang"), "lang", "left_anti").select("lang", "low", F.col("low").alias("high"))
        spans = write_and_read(lower.union(rest), "thresholds")
    total = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    order = (F.desc("score"), F.desc("f"), F.asc("phrase"))
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    heads = best.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= keep)
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= keep).join(total, "lang").select(
        "lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", F.col("score").cast("long").alias("score")
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read_table(spark, sf_dir, "documents"))


_INNER = " UNION ALL ".join(
    f"SELECT lang, f, unnest(list_transform(range(1, m + 2 - {m}), lambda i: array_to_string(w[i:i + {m - 1}], ' '))) AS phrase FROM cand WHERE m > {m}"
    for m in range(2, LONGEST)
)

ORACLE = f"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
        FROM documents)
), numbered AS (
  SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces
), words AS (
  SELECT lang, p, unnest(w) AS w1, unnest(range(len(w))) AS i FROM numbered
), runs AS (
  SELECT lang, w1, {", ".join(f"lead(w1, {k}) OVER (PARTITION BY p ORDER BY i) AS w{k + 1}" for k in range(1, LONGEST))} FROM words
), grams AS (
  {" UNION ALL ".join(
    f"SELECT lang, {m} AS m, {' || chr(32) || '.join(f'w{k}' for k in range(1, m + 1))} AS phrase FROM runs WHERE w{m} IS NOT NULL"
    for m in range(1, LONGEST + 1))}
), f AS (
  SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL
), total AS (
  SELECT lang, count(*)::BIGINT AS n FROM words GROUP BY lang
), cand AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= {LEAST}
), cuts AS (
  SELECT lang, m, phrase, f, w, unnest(range(1, m)) AS k FROM cand
), scores AS (
  SELECT c.lang, c.phrase, c.m, c.f AS a, k, l.f AS l, r.f AS r, ({SCALE} * c.f) // (l.f + r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
              JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
), lowest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), covers AS (
  SELECT lang, phrase, max(f) AS f FROM ({_INNER}) GROUP BY ALL
), kept AS (
  SELECT o.* FROM lowest o LEFT JOIN covers c ON c.lang = o.lang AND c.phrase = o.phrase
  WHERE c.f IS NULL OR 100 * c.f < {COVER_PERCENT} * o.a
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
JOIN total USING (lang) WHERE rank <= {KEEP}
"""
