"""Language identification, toxicity and the pipeline on made-up texts."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from llm_fixtures import documents, odd, prose  # noqa: F401

from rosterlake.llm import language_id, toxicity

SYLLABLES = {"en": "the an er ou ing ly".split(), "de": "sch ein ung ä ver zu".split(), "fr": "eau é que oi è la".split()}


def words(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_id(documents, odd):
    rng = random.Random(1)
    lang = {i: rng.choice(list(SYLLABLES)) for i in range(600)}
    rows = [(i, words(lang[i], rng.randint(3, 150), rng)) for i in lang]
    rows += [(None if i is None else 800 + i, t) for i, t in odd if t is not None or i is not None]
    rows += [(700, "12 34 !?"), (701, words("de", 30_000, rng))]
    df = documents(rows, 4, lang=lambda i: lang.get(i))
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    held = [i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in lang)
    assert np.mean([got[i].lang_pred == lang[i] for i in held]) >= 0.95
    assert got[701].lang_pred == "de" and got[700].lang_pred == "und" and got[700].score == 0.0
    assert all(0 <= r.score <= 1 and r.lang_pred in {*SYLLABLES, "und"} for r in got.values())
    again = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df.repartition(2)).collect()}
    assert again == {i: (r.lang_pred, r.score) for i, r in got.items()}


def test_language_id_without_labels(documents, odd):
    got = language_id.identify(documents(odd, lang=lambda i: None)).collect()
    assert len(got) == len(odd) and {r.lang_pred for r in got} == {"und"}
    assert language_id.identify(documents([], 1)).count() == 0


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    net = language_id.Network(["a", "b", "c"])
    net.tables, net.bias = ([p.astype(float) for p in ps] for ps in (net.tables, net.bias))
    net.out, net.out_bias = net.out.astype(float), net.out_bias.astype(float)
    x, y = rng.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def loss():
        pooled, _ = net._pooled(x)
        p = language_id.softmax(np.maximum(pooled, 0) @ net.out + net.out_bias)
        return -np.log(p[np.arange(5), y]).mean()

    for p, g in zip(net.parameters(), net.gradients(x, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], 1e-6
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(float(g[at]), rel=1e-3)


def test_folded_tables_predict_the_same():
    rng = np.random.default_rng(3)
    net = language_id.Network(["a", "b"])
    x = rng.integers(0, 256, (130, language_id.WINDOW)).astype(np.uint8)
    pooled, _ = net._pooled(x)
    want = np.log(language_id.softmax((np.maximum(pooled, 0) @ net.out + net.out_bias).astype(float)))
    assert language_id.Predictor(net).log_probabilities(x) == pytest.approx(want, abs=1e-4)


def test_windows_hold_every_byte():
    texts = [b"", b"a" * 5, b"b" * 256, b"c" * 257, bytes(range(256)) * 4]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    windows, doc = language_id.windows_of(data, offsets)
    for i, t in enumerate(texts):
        parts = windows[doc == i]
        whole = bytearray()
        for k, w in enumerate(parts):
            whole[k * language_id.STRIDE :] = w.tobytes()
        assert bytes(whole[: len(t)]) == t and not any(whole[len(t) :])


# -- toxicity --------------------------------------------------------------------

INSULTS = "idiot moron stupid loser worthless".split()
HIDDEN = {"idiot": ["1d10t", "i d i o t", "i.d.i.o.t", "idiiiiot"], "moron": ["m0r0n", "m-o-r-o-n"], "stupid": ["$tup1d", "s t u p i d"]}


@pytest.fixture
def toxic_corpus(documents, spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        text = words("en", rng.randint(5, 80), rng).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randint(0, len(text)), rng.choice(INSULTS))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic), 1))
    for k, (_, forms) in enumerate(HIDDEN.items()):
        for j, form in enumerate(forms):
            rows.append((2000 + 10 * k + j, f"{words('en', 10, rng)} {form} {words('en', 10, rng)}"))
    table = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    return rows, dict((i, t) for i, t, _ in labels), documents(rows, 4), table


def test_toxicity(toxic_corpus, odd, documents):
    rows, truth, df, labels = toxic_corpus
    got = {r.doc_id: r for r in toxicity.score(df, labels).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in truth)
    assert np.mean([got[i].predicted == truth[i] for i in held]) >= 0.97
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    hidden = [got[i].predicted for i in got if i >= 2000]
    assert np.mean(hidden) >= 0.8
    mixed = documents([*rows[:200], *((i if i is None else 3000 + i, t) for i, t in odd)], 3)
    scored = toxicity.score(mixed, labels).collect()
    assert len(scored) == 200 + len(odd) and all(0 <= r.score <= 1 for r in scored)
    assert not any(r.predicted for r in scored if r.doc_id in (3001, 3002, 3003))
    kept = toxicity.keep_clean(mixed, labels)
    assert kept.columns == mixed.columns and kept.count() == sum(r.predicted == 0 for r in scored)


def test_toxicity_without_labels(documents, odd, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.score(documents(odd), none).collect()} == {(0.0, 0)}
    assert toxicity.score(documents([], 1), none).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1), (4, None), (None, 0)], "doc_id long, toxic int")
    assert toxicity.score(documents(odd), one).count() == len(odd)


def test_restoring(documents):
    reader = toxicity.Reader(toxicity.smoothed(counts_of(" ".join(INSULTS * 20))))
    assert reader.restored("you 1d10t and m0r0n") == "you idiot and moron"
    assert reader.restored("an i d i o t") == "an idiot"
    assert reader.restored("4.0 was +1 (736)") == "4.0 was +1 (736)"
    got = toxicity.restore(documents([(1, "plain"), (2, None)], 1))
    assert {(r.doc_id, r.restored) for r in got.collect()} == {(1, "plain"), (2, "")}


def counts_of(text):
    k = np.concatenate([[0], toxicity.classes_of(text), [0]]).astype(np.int64)
    code = (np.concatenate([[0], k[:-2]]) * 64 + k[:-1]) * 64 + k[1:]
    return np.bincount(code[(k[:-1] > 0) | (k[1:] > 0)], minlength=64**3).reshape(64, 64, 64)
