"""Language identification by a byte convolutional network.

Texts are cut into windows of fixed length. Filters of several widths run over a window's
bytes, each is pooled to its maximum, and a softmax layer turns the maxima into language
probabilities. A filter over one-hot bytes is a sum of table rows, so training gathers and
adds rows of numpy tables, and gradients reach only the positions the maxima came from; for
prediction the tables are folded to two bytes a look-up. A text's languages are weighed by
the mean log probability over all its windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlake.llm.common import read_table, text_batches

#: Bytes of a window, and how far the next one begins: they share the widest filter less one.
WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 24
STRIDE = WINDOW - max(WIDTHS) + 1
#: Labelled rows a language is learned from at most, picked by a hash of doc_id, and windows of each.
FIT_PER_LANGUAGE, FIT_WINDOWS = 2500, 2
EPOCHS, BATCH, RATE = 5, 128, 0.01
UNDETERMINED = "und"
#: Parts in which the ids of a language are ranked first; each hands on FIT_PER_LANGUAGE at most.
_PARTS = 64
#: Windows predicted at a time.
_CHUNK = 64

_LETTER = re.compile(r"[^\W\d_]")


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, document): all texts cut into windows; the last of a text is filled up with 0."""
    lengths = np.diff(offsets)
    counts = np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(counts) - counts
    start = offsets[:-1][doc] + (np.arange(len(doc)) - first[doc]) * STRIDE
    at = start[:, None] + np.arange(WINDOW)[None, :]
    inside = at < offsets[1:][doc][:, None]
    if not len(data):
        return np.zeros((len(doc), WINDOW), np.uint8), doc
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8), doc


class Network:
    """Tables [width][offset, byte, filter], their biases, and the softmax layer."""

    def __init__(self, languages: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.bias, self.out, self.out_bias]

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        best, places = [], []
        for table, bias, width in zip(self.tables, self.bias, WIDTHS, strict=True):
            n = WINDOW - width + 1
            value = sum(table[o][x[:, o : o + n]] for o in range(width))
            place = value.argmax(1)
            best.append(np.take_along_axis(value, place[:, None, :], 1)[:, 0] + bias)
            places.append(place)
        return np.concatenate(best, axis=1), places

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        pooled, places = self._pooled(x)
        hidden = np.maximum(pooled, 0)
        error = softmax(hidden @ self.out + self.out_bias)
        error[np.arange(len(y)), y] -= 1
        error /= len(y)
        back = (error @ self.out.T) * (pooled > 0)
        tables, biases = [], []
        for i, (width, place) in enumerate(zip(WIDTHS, places, strict=True)):
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            biases.append(part.sum(0))
            row = np.arange(len(x))[:, None]
            cells = [x[row, place + o].astype(np.int64) * FILTERS + np.arange(FILTERS) for o in range(width)]
            grads = [np.bincount(c.ravel(), part.ravel(), 256 * FILTERS).reshape(256, FILTERS) for c in cells]
            tables.append(np.stack(grads))
        return [*tables, *biases, hidden.T @ error, error.sum(0)]

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 2) -> Network:
        """Adam over shuffled batches; windows are cut short at random, so short texts are known too."""
        rng = np.random.default_rng(seed)
        parameters = self.parameters()
        m, v = ([np.zeros_like(p, dtype=float) for p in parameters] for _ in range(2))
        step, steps = 0, max(1, EPOCHS * -(-len(x) // BATCH))
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                rows = order[at : at + BATCH]
                some = x[rows].copy()
                short = rng.random(len(rows)) < 0.4
                length = rng.integers(4, WINDOW, len(rows))
                some[short[:, None] & (np.arange(WINDOW)[None, :] >= length[:, None])] = 0
                step += 1
                rate = RATE * (1 - 0.9 * step / steps)
                for p, g, a, b in zip(parameters, self.gradients(some, y[rows]), m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Predictor:
    """A trained network with tables over two bytes, for speed."""

    def __init__(self, network: Network):
        self.network = network
        pair = lambda t, o: (t[o][:, None, :] + t[o + 1][None, :, :]).reshape(1 << 16, FILTERS)
        self.steps = [
            ([(o, pair(t, o)) for o in range(0, w - 1, 2)], (w - 1, t[w - 1]) if w % 2 else None)
            for t, w in zip(network.tables, WIDTHS, strict=True)
        ]

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = [self._some(windows[i : i + _CHUNK]) for i in range(0, len(windows), _CHUNK)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.network.languages)))

    def _some(self, x: np.ndarray) -> np.ndarray:
        pairs = x[:, :-1].astype(np.int64) * 256 + x[:, 1:]
        best = []
        for (doubles, single), bias, width in zip(self.steps, self.network.bias, WIDTHS, strict=True):
            n = WINDOW - width + 1
            value = np.take(doubles[0][1], pairs[:, :n], axis=0)
            for o, table in doubles[1:]:
                value += np.take(table, pairs[:, o : o + n], axis=0)
            if single:
                value += np.take(single[1], x[:, single[0] : single[0] + n], axis=0)
            best.append(value.max(1) + bias)
        # Not a matrix product: its sums would depend a little on the rows that happen to be together.
        hidden = np.maximum(np.concatenate(best, axis=1), 0).astype(float)
        z = np.einsum("ij,jk->ik", hidden, self.network.out.astype(float)) + self.network.out_bias
        top = z.max(1, keepdims=True)
        return z - top - np.log(np.exp(z - top).sum(1, keepdims=True))


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in text_batches(batch, "text", 4 << 20):
            windows, doc = windows_of(data, offsets)
            counts = np.bincount(doc, minlength=part.num_rows)
            first = np.cumsum(counts) - counts
            for k in range(FIT_WINDOWS):  # spread over the text
                at = first + counts * k // FIT_WINDOWS
                new = np.ones(len(at), bool) if k == 0 else counts > k
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").filter(pa.array(new)), part.column("lang").filter(pa.array(new))]
                    + [pa.array([w.tobytes() for w in windows[at[new]]], pa.binary())],
                    names=["doc_id", "lang", "window"],
                )


def held_out(doc_id: F.Column) -> F.Column:
    """CRC-32 of the doc_id as text leaves 2 modulo 4; FALSE for NULL."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, per_language: int = FIT_PER_LANGUAGE) -> Network | None:
    """A network trained on a bounded sample of ``docs(doc_id, text, lang)`` that is not held out."""
    labelled = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    order = [F.xxhash64(F.col("doc_id").cast("long")), F.col("doc_id")]
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id").cast("long")), F.lit(_PARTS))
    ranked = labelled.select("doc_id", "lang", part.alias("part"))
    # What is among the first of its language is so in its part of it, too.
    for within in (["lang", "part"], ["lang"]):
        turn = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
        ranked = ranked.withColumn("turn", turn).filter(F.col("turn") <= per_language).drop("turn")
    chosen = ranked.select(F.col("doc_id").alias("its"))
    # So many ids per language at most are broadcast.
    picked = labelled.join(F.broadcast(chosen.distinct()), F.col("doc_id") == F.col("its"))
    rows = (
        picked.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
        .mapInArrow(_sample_windows, "doc_id long, lang string, window binary")
        .toPandas()
        .sort_values(["doc_id", "lang", "window"])
    )
    if not len(rows):
        return None
    languages = sorted(rows["lang"].unique())
    x = np.frombuffer(b"".join(rows["window"]), np.uint8).reshape(-1, WINDOW)
    y = np.searchsorted(np.array(languages, object), rows["lang"].to_numpy(object))
    return Network(languages).train(x, y)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        predictor = Predictor(network) if network else None
        for batch in batches:
            for part, data, offsets in text_batches(batch, "text", 1 << 20):
                texts = part.column("text").to_pylist()
                letters = [bool(t) and _LETTER.search(t) is not None for t in texts]
                names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                if predictor:
                    windows, doc = windows_of(data, offsets)
                    logs = predictor.log_probabilities(windows)
                    total = np.stack([np.bincount(doc, logs[:, k], len(texts)) for k in range(logs.shape[1])], axis=1)
                    chance = softmax(total / np.bincount(doc, minlength=len(texts))[:, None])
                    for i in np.flatnonzero(letters):
                        k = int(chance[i].argmax())
                        names[i], scores[i] = network.languages[k], float(chance[i, k])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names), pa.array(scores)], names=["doc_id", "lang_pred", "score"]
                )

    return run


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from text and lang of rows that are not held out; a prediction depends on the
    text alone, all of it. A NULL text, or one without a letter, is 'und' with score 0, and
    so is every text if no row has a language. A NULL doc_id is not held out and not
    learned from. Equal texts get equal results; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    # As large as the network, whatever the data.
    shared = docs.sparkSession.sparkContext.broadcast(learn(rows))
    typed = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = typed.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
