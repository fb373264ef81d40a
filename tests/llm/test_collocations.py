"""Collocations against plain counting of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import documents, odd, prose  # noqa: F401
from pyspark.sql import functions as F

from rosterlake.llm import collocations as co


def brute(rows, keep, least):
    """{lang: [(rank, phrase, a, l, r, n, score), …]} from every phrase of one to four words."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, 5):
                f[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = {}
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = set()
        for q, b in candidates.items():
            for size in range(2, len(q)):
                covered |= {q[i : i + size] for i in range(len(q) - size + 1) if 100 * b >= 80 * counts[q[i : i + size]]}
        rows_ = []
        for p, a in candidates.items():
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if p not in covered:
                rows_.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        rows_.sort()
        if rows_:
            out[lang] = [(i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(rows_[:keep], 1)]
    return out


def mined(table, **kw):
    got = defaultdict(list)
    for r in co.mine(table, **kw).orderBy("lang", "rank").collect():
        got[r.lang].append((r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score))
    return dict(got)


def sentences(seed, n):
    rng, fixed = random.Random(seed), ["New York City Hall", "of the", "a b a b a", "größte Stadt der Welt", "x y\tz", "AB ab"]
    vocabulary = [f"w{i}" for i in range(40)] + ["Zé", "日本", "a", "the", "😀"]
    out = []
    for _ in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocabulary[: rng.randint(2, 45)]) for _ in range(rng.randint(0, 30))]
        out.append("".join(w + rng.choice([" ", " ", " ", "  ", ". ", ",", "\n", "; ", "\x0b"]) for w in words))
    return out


@pytest.mark.parametrize("keep,least,block", [(5, 3, 400), (40, 4, 3000), (2000, 2, 4 << 20)])
def test_equal_to_counting_everything(spark, documents, odd, monkeypatch, keep, least, block):
    monkeypatch.setattr(co, "PART_BYTES", block)
    monkeypatch.setattr(co, "FIRST", 1)  # so that the threshold has to fall
    monkeypatch.setattr(co, "WIDEN", 2)
    rows = [*odd, *enumerate(sentences(keep, 250), 100)]
    lang = lambda i: None if i is None else ("en", "de", None, "und", "fr")[i % 5]
    got = mined(documents(rows, lang=lang), keep=keep, least=least)
    assert got == brute([(lang(i), t) for i, t in rows], keep, least)


def test_full_bitmaps_change_nothing(spark, documents, monkeypatch):
    monkeypatch.setattr(co, "BITMAP_BITS", 32)
    monkeypatch.setattr(co, "bitmap", lambda phrases: np.full(1, 0xFFFFFFFF, np.uint32))
    rows = list(enumerate(sentences(9, 120)))
    assert mined(documents(rows), keep=20, least=3) == brute([("en", t) for _, t in rows], 20, 3)


def test_empty_tables(spark, documents):
    assert co.mine(documents([(1, "a")]).limit(0)).count() == 0
    assert co.mine(documents([(1, None), (2, " . ")])).count() == 0


def test_hashes_agree(spark):
    phrases = ["a", "zé 日本", "x y z w", "\x00 \x1c"]
    table = spark.createDataFrame([("en", p) for p in phrases], "lang string, phrase string")
    got = [r[0] & (2**64 - 1) for r in table.select(co.phrase_hash(F.col("lang"), F.col("phrase"))).collect()]
    import pyarrow as pa

    want = []
    for phrase in phrases:
        data = np.frombuffer(phrase.encode(), np.uint8)
        words = co.Words(data, np.array([0, len(data)]), pa.array(["en"]))
        want.append(int(words.hashes_at(phrase.count(" ") + 1)[0]))
    assert got == want


def test_shares_beyond_64_bits(spark):
    row = spark.sql("select 9000000000000000000L a, 9000000000000000001L b")
    assert row.select(co._share(F.col("a"), F.col("b").cast("decimal(20,0)") * 2)).first()[0] == 999999
