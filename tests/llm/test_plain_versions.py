"""Language identification against a forward pass in plain loops, the choice of its sample, the index alone."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from llm_fixtures import documents  # noqa: F401
from test_learned_operators import SYLLABLES, words
from test_vector_operators import brute_nearest, clustered, vectors  # noqa: F401

from rosterlake.llm import adaptive_scan, language_id


def loop_forward(net: language_id.Network, window: bytes) -> list[float]:
    """Log probabilities of one window, position by position and filter by filter."""
    hidden = []
    for table, bias, width in zip(net.tables, net.bias, language_id.WIDTHS, strict=True):
        for f in range(language_id.FILTERS):
            best = -math.inf
            for at in range(len(window) - width + 1):
                best = max(best, sum(float(table[o, window[at + o], f]) for o in range(width)))
            hidden.append(max(best + float(bias[f]), 0.0))
    z = [sum(h * float(w) for h, w in zip(hidden, net.out[:, k])) + float(net.out_bias[k]) for k in range(len(net.languages))]
    total = math.log(sum(math.exp(v - max(z)) for v in z)) + max(z)
    return [v - total for v in z]


def loop_predict(net: language_id.Network, text: str) -> tuple[str, float]:
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    data, starts = text.encode(), [0]
    while starts[-1] + language_id.WINDOW < len(data):
        starts.append(starts[-1] + language_id.STRIDE)
    logs = [loop_forward(net, data[s : s + language_id.WINDOW].ljust(language_id.WINDOW, b"\0")) for s in starts]
    mean = [sum(column) / len(logs) for column in zip(*logs)]
    scale = sum(math.exp(m) for m in mean)
    best = max(range(len(mean)), key=lambda k: mean[k])
    return net.languages[best], math.exp(mean[best]) / scale


def test_predictions_equal_plain_loops(documents):
    rng = random.Random(4)
    lang = {i: rng.choice(list(SYLLABLES)) for i in range(200)}
    rows = [(i, words(lang[i], rng.randint(3, 60), rng)) for i in lang] + [(900, "12 34"), (901, ""), (902, "é")]
    df = documents(rows, 3, lang=lambda i: lang.get(i))
    net = language_id.learn(df.select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert len({r.lang_pred for r in got.values()}) == 4
    for i, text in [*rows[:12], *rows[-3:]]:
        name, score = loop_predict(net, text)
        assert got[i].lang_pred == name and got[i].score == pytest.approx(score, abs=1e-4)


def test_the_sample_is_the_first_of_each_language_by_hash(documents, monkeypatch):
    rng = random.Random(6)
    rows = [(i, words("en", 4, rng)) for i in range(900)] + [(5, words("en", 4, rng))] * 40
    df = documents(rows, 3, lang=lambda i: "hot" if i % 10 else "rare").select("doc_id", "text", "lang")
    usable = df.filter(~language_id.held_out(df.doc_id)).selectExpr("doc_id", "lang", "xxhash64(doc_id) AS h").collect()
    trained = []
    monkeypatch.setattr(language_id.Network, "train", lambda self, x, y: trained.append((x, y)) or self)
    net = language_id.learn(df, per_language=30)
    picked = {
        name: {r.doc_id for r in sorted((r for r in usable if r.lang == name), key=lambda r: (r.h, r.doc_id))[:30]}
        for name in net.languages
    }
    texts = {i: t for i, t in rows[:900]}
    (x, y), seen = trained[0], {}
    for window, label in zip(x, y, strict=True):
        seen.setdefault(net.languages[label], set()).add(window.tobytes().rstrip(b"\0").decode())
    assert seen == {name: {texts[i] for i in ids if i != 5} | ({t for i, t in rows if i == 5} if 5 in ids else set()) for name, ids in picked.items()}


def test_recall_of_the_index_alone(vectors, monkeypatch):
    """A fit sample far below the table, and nothing found by comparing the sample itself."""
    monkeypatch.setattr(adaptive_scan, "FIT_ROWS", 256)
    monkeypatch.setattr(adaptive_scan, "_seeds", lambda shared: lambda batches: iter(()))
    rows = [(i, np.float32(e), l) for i, e, l in clustered(6000, 9, width=24, spread=0.2)]
    got = adaptive_scan.nearest(vectors(rows)).collect()
    want = brute_nearest(rows, 20, 20)
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(mine.get(q, set()) & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
