"""Toxicity scores on text restored from obfuscation by a noisy-channel model.

A character trigram model is counted over all documents. Tokens that may hide a word
(digits or signs among or for letters, a separator between letters, letters repeated three times,
three single letters set apart by blanks) become a lattice: each character may stand for itself, for a letter it
looks like, or for nothing. Viterbi decoding under the trigram model picks the reading.

The restored words are scored against evidence learned from labelled rows: words and word
beginnings, by the lower bound of their log odds in a bounded sample. A logistic regression
over a document's strongest words gives the score; it is fitted on rows of each half of the
sample by the evidence of the other half.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.common import give_back, read_table, text_batches, write_and_read

#: Labelled rows the classifier learns from, of either label; picked by a hash of doc_id.
FIT_TOXIC, FIT_CLEAN = 4000, 6000
THRESHOLD = 0.7
#: Tokens a worker remembers; beyond that it starts over, which changes no result.
REMEMBERED = 200_000
#: Lengths of word beginnings that count as evidence.
BEGINNINGS = (4, 5, 6)
#: Evidence must have been seen in so many toxic documents.
LEAST_SEEN = 3
#: Lower bound of the log odds from which a word or beginning is evidence.
LEAST_STRENGTH = 1.0

_CLASSES = 64
# Letters that digits and signs are used for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
    "*": "aeiou",
}
_SEPARATORS = set(".-_*~'`^#/\\")
_SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGN = re.compile("[" + re.escape("".join(LOOKS_LIKE)) + "]")
_REPEATED = re.compile(r"([^\W\d_])\1\1", re.IGNORECASE)
_APART = re.compile(r"[^\W\d_][.\-_*~'`^#/\\]+[^\W\d_]")
_PLUS = re.compile(r"\+[.,]?\d")


def _class_table() -> np.ndarray:
    """Class of a code point: 0 no letter, 1-26 a-z, 27-57 Latin-1 letters, 58 any other letter."""
    table = np.zeros(0x10000, np.uint8)
    for code in range(0x10000):
        c = chr(code).lower()
        if not c.isalpha() or len(c) > 1:
            continue
        table[code] = ord(c) - 96 if "a" <= c <= "z" else ord(c) - 0xDF + 27 if 0xDF <= ord(c) <= 0xFD else 58
    return table


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    return _class_table()


def classes_of(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _classes()[np.minimum(code, 0xFFFF)]


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_CLASSES**3, np.int64)
    for batch in batches:
        for _, data, offsets in text_batches(batch, "text", 1 << 20):
            # A line feed between documents keeps their letters apart.
            text = np.insert(data, offsets[1:-1], 10).tobytes().decode("utf-8", "replace")
            k = np.concatenate([[0], classes_of(text), [0]]).astype(np.int32)
            code = (np.concatenate([[0], k[:-2]]) * _CLASSES + k[:-1]) * _CLASSES + k[1:]
            total += np.bincount(code[(k[:-1] > 0) | (k[1:] > 0)], minlength=_CLASSES**3)
    give_back()
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["code", "n"])


def trigram_model(rows: DataFrame) -> np.ndarray:
    """log p(c | a, b) by [a, b, c], counted over all of ``rows(text)``.

    The counts that come to the driver are bounded by the cube of the number of classes.
    """
    counted = rows.select("text").mapInArrow(_count_trigrams, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    counts = np.zeros(_CLASSES**3)
    counts[got["code"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    return smoothed(counts.reshape(_CLASSES, _CLASSES, _CLASSES))


def smoothed(counts: np.ndarray) -> np.ndarray:
    def share(c: np.ndarray) -> np.ndarray:
        return (c + 1e-3) / (c + 1e-3).sum(-1, keepdims=True)

    both = 0.7 * share(counts) + 0.25 * share(counts.sum(0))[None] + 0.05 * share(counts.sum((0, 1)))[None, None]
    return np.log(both).astype(np.float32)


class Channel:
    """Viterbi decoding of one token under the trigram model."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def readings(self, c: str, before: str) -> list[tuple[str, float]]:
        """What an observed character may stand for, with the channel's log probability."""
        if c.isalpha():
            same = [(c, math.log(0.9))]
            return [*same, ("", math.log(0.5))] if c == before else same
        out = [(x, math.log(0.8 / len(LOOKS_LIKE[c]))) for x in LOOKS_LIKE.get(c, "")]
        return [*out, ("", math.log(0.9 if c in _SEPARATORS or c.isspace() else 0.05))]

    def decode(self, token: str) -> str:
        """The likeliest word behind ``token``, in lower case."""
        model, table = self.model, _classes()
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before = ""
        for c in token.lower():
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for letter, chance in self.readings(c, before):
                k = int(table[min(ord(letter), 0xFFFF)]) if letter else 0
                for (a, b), (score, said) in paths.items():
                    if letter:
                        state, value = (b, k), score + chance + model[a][b][k]
                    else:
                        # Leaving a character out saves a letter; it must not win by being short.
                        state, value = (a, b), score + chance - 2.0
                    if state not in step or value > step[state][0]:
                        step[state] = (value, (letter, said) if letter else said)
            paths, before = step, c
        _, said = max(
            ((score + model[a][b][0], said) for (a, b), (score, said) in paths.items()), key=lambda x: x[0]
        )
        letters = []
        while said:
            letters.append(said[0])
            said = said[1]
        return "".join(reversed(letters))


def hides_something(token: str) -> bool:
    """Whether a token may be an obfuscated word."""
    if token.isalpha():
        return bool(_REPEATED.search(token))
    inner = token.strip(".,;:?\"'()[]{}")
    letters, figures = sum(map(str.isalpha, inner)), sum(map(str.isdigit, inner))
    figures += not letters and bool(_PLUS.match(inner))  # the plus before a number is part of it
    signs = sum(c in LOOKS_LIKE for c in inner)
    if letters + signs < 2 or letters + signs == figures:  # a sign stands for a letter; a number is no word
        return False
    return bool(_SIGN.search(inner) or _REPEATED.search(inner) or _APART.search(inner))


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)]


class Reader:
    """Words a token stands for: its own, and the restored one if it may hide another."""

    def __init__(self, model: np.ndarray):
        self.channel = Channel(model)

    def words(self, token: str) -> list[str]:
        words = [w.lower() for w in _LETTERS.findall(token)]
        if hides_something(token):
            words.append(self.channel.decode(token.strip(".,;:?\"'()[]{}")))
        return list(dict.fromkeys(w for w in words if w))

    def tokens(self, text: str) -> set[str]:
        found = set(text.split())
        for match in _SPACED.finditer(text):
            found.add(match.group().replace(" ", "-"))  # read as one token with separators
        return found

    def restored(self, text: str) -> str:
        """The text with every obfuscated token in its restored reading."""

        def one(match: re.Match) -> str:
            token = match.group()
            return self.channel.decode(token.strip(".,;:?\"'()[]{}")) if hides_something(token) else token

        text = _SPACED.sub(lambda m: self.channel.decode(m.group()), text)
        return re.sub(r"\S+", one, text)


class Scorer(dict):
    """Strength of evidence by token; the document's score from its strongest words."""

    def __init__(self, model: np.ndarray, evidence: dict[str, float], weights: np.ndarray | None, base: float):
        self.reader = Reader(model)
        self.evidence, self.weights, self.base = evidence, weights, base

    def __missing__(self, token: str) -> float:
        best = 0.0
        for word in self.reader.words(token):
            best = max(best, *(self.evidence.get(f, 0.0) for f in features(word)))
        if len(self) >= REMEMBERED:
            self.clear()
        if len(token) <= 64:
            self[token] = best
        return best

    def summary(self, text: str) -> list[float]:
        tokens = self.reader.tokens(text)
        strong = sorted((s for s in map(self.__getitem__, tokens) if s > 0), reverse=True)
        top = (strong + [0.0, 0.0, 0.0])[:3]
        return [*top, math.log1p(len(strong))]

    def score(self, text: str) -> float:
        if self.weights is None:
            return self.base
        z = float(np.dot(self.weights[:-1], self.summary(text)) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights and intercept by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def lower_log_odds(p: np.ndarray, n: np.ndarray, n_toxic: float, n_clean: float, z: float = 1.96) -> np.ndarray:
    """Lower confidence bound of how much more often toxic documents hold a feature."""
    odds = np.log((p + 0.5) / (n_toxic + 1)) - np.log((n + 0.5) / (n_clean + 1))
    return odds - z * np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5) * (n > 0))


def _feature_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            for text, toxic, half in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "half")), strict=True):
                words = {w for t in reader.tokens(text or "") for w in reader.words(t)}
                found = sorted({f for w in words for f in features(w)})
                numbers = [pa.array([x] * len(found), pa.int32()) for x in (toxic, half)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *numbers], names=["feature", "toxic", "half"])
        give_back()

    return run


def _summaries(shared):
    """Strongest words of each sample row, by what the other half of the sample says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, evidence = shared.value
        scorers = [Scorer(model, evidence[1 - half], None, 0.0) for half in (0, 1)]
        for batch in batches:
            texts, halves = batch.column("text").to_pylist(), batch.column("half").to_pylist()
            rows = [scorers[half].summary(t or "") for t, half in zip(texts, halves, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), batch.column("toxic")], names=["summary", "toxic"]
            )
        del scorers
        give_back()

    return run


def fit(docs: DataFrame, labels: DataFrame, fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN) -> tuple:
    """(trigram model, evidence, weights, base rate) from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    Without rows of both labels in both halves of the sample the score is the share of
    toxic ones, 0 if none is labelled.
    """
    spark = docs.sparkSession
    model = trigram_model(docs)
    learn = labels.filter("doc_id is not null and toxic in (0, 1)").filter(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    )
    order = F.xxhash64(F.col("doc_id").cast("long"))
    picked = (
        learn.filter("toxic = 1").orderBy(order, "doc_id").limit(fit_toxic)
        .unionByName(learn.filter("toxic = 0").orderBy(order, "doc_id").limit(fit_clean))
    )
    # At most FIT_TOXIC + FIT_CLEAN pairs of numbers are broadcast.
    sample = docs.join(F.broadcast(picked.select(F.col("doc_id").alias("its"), "toxic")), F.col("doc_id") == F.col("its"))
    sample = write_and_read(
        sample.select("text", F.col("toxic").cast("int").alias("toxic"), F.pmod(order, F.lit(2)).cast("int").alias("half")),
        "toxicity_sample",
    )
    sizes = {(r["half"], r["toxic"]): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    known = sum(sizes.values())
    base = sum(n for (_, toxic), n in sizes.items() if toxic) / known if known else 0.0
    if len(sizes) < 4:
        return model, {}, None, base
    shared = spark.sparkContext.broadcast(model)
    rows = sample.mapInArrow(_feature_rows(shared), "feature string, toxic int, half int")
    counted = (
        rows.groupBy("feature")
        .agg(
            *[F.sum(F.when(F.col("half") == h, F.col("toxic")).otherwise(0)).alias(f"p{h}") for h in (0, 1)],
            *[F.sum(F.when(F.col("half") == h, 1 - F.col("toxic")).otherwise(0)).alias(f"n{h}") for h in (0, 1)],
        )
        .filter(F.col("p0") + F.col("p1") >= LEAST_SEEN)
        .toPandas()
    )

    def evidence(*halves: int) -> dict[str, float]:
        p, n = (sum(counted[f"{c}{h}"].to_numpy(float) for h in halves) for c in "pn")
        toxic, clean = (sum(sizes[h, label] for h in halves) for label in (1, 0))
        strength = lower_log_odds(p, n, toxic, clean)
        strong = (p >= LEAST_SEEN) & (strength > LEAST_STRENGTH)
        return dict(zip(counted["feature"][strong], strength[strong].tolist(), strict=True))

    shared = spark.sparkContext.broadcast((model, (evidence(0), evidence(1))))
    got = sample.mapInArrow(_summaries(shared), "summary array<double>, toxic int").toPandas()
    y, x = got["toxic"].to_numpy(float), np.array(got["summary"].tolist())
    order = np.lexsort((*x.T, y))  # sums do not depend on the order rows arrive in
    return model, evidence(0, 1), fit_logistic(x[order], y[order]), base


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            scores = [scorer.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])
        scorer.clear()
        give_back()

    return run


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold``).

    Learns from ``labels(doc_id, toxic)`` of the rows that are not held out (CRC-32 of the
    doc_id as text, modulo 3, is 1); a score depends on the text alone. NULL texts are
    scored as empty ones, a NULL doc_id is not held out. Equal texts get equal scores.
    Texts are read whole; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = labels.select("doc_id", "toxic").distinct()
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, known))
    typed = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = typed.mapInArrow(_score(shared), "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted toxic.

    A NULL text is judged as an empty one; a NULL doc_id and repeated rows are judged like others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic").distinct())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keep = [scorer.score(t.as_py() or "") < threshold for t in part.column("text")]
                yield part.filter(pa.array(keep, pa.bool_()))
        scorer.clear()
        give_back()

    return docs.mapInArrow(run, docs.schema)


def restore(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, restored): texts with obfuscated tokens in their restored reading; '' for NULL."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(trigram_model(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            texts = [reader.restored(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "restored"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, restored string")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
