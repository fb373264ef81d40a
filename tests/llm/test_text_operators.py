"""Text operators against brute force, and on odd rows and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import documents, odd, prose  # noqa: F401
from tokenizers import Tokenizer

from rosterlake.llm import bpe_automaton, license_scan, ngram_join, source_mix, substring_lines, suffix_dedup


def by_id(df, *columns):
    return sorted(((r["doc_id"], *(r[c] for c in columns)) for r in df.collect()), key=repr)


# -- 4: suffix-array dedup --------------------------------------------------


def brute_repeats(rows, length=50):
    low = {}
    texts = [(-(10**9) if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for at in range(len(b) - length + 1):
            s = b[at : at + length]
            low[s] = min(low.get(s, i), i)
    out = []
    for (i, _), (rank, b) in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for at in range(len(b) - length + 1):
            if low[b[at : at + length]] < rank:
                gone[at : at + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(b), spans, kept))
    return sorted(out, key=repr)


def repeats(df):
    rows = suffix_dedup.remove_repeats(df).collect()
    return sorted(
        ((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in rows), key=repr
    )


def test_repeats_equal_brute_force(documents, prose):
    rng = random.Random(5)
    passages = [prose(rng.randint(8, 60), 100 + i) for i in range(12)]
    rows = []
    for i in range(120):
        parts = [prose(rng.randint(0, 60), i)]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : a + rng.randint(20, len(p))], prose(rng.randint(0, 5), 1000 + i)]
        rows.append((i, "".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, "ab" * 200), (203, "ab" * 90), (204, "\0" * 120), (205, "\0" * 70)]
    assert repeats(documents(rows, 6)) == brute_repeats(rows)


def test_repeats_of_exactly_the_length(documents, prose):
    s = prose(30, 77)
    rows = [(1, "A" + s[:50] + "B"), (2, "C" + s[:50] + "D"), (3, "E" + s[:49] + "F"), (4, s[:50]), (0, s[:49])]
    assert repeats(documents(rows, 5)) == brute_repeats(rows)


def test_repeats_odd_rows(documents, odd, spark):
    rows = [*odd, (10, odd[5][1][1000:1400]), (11, "x" * 60)]
    assert repeats(documents(rows, 4)) == brute_repeats(rows)
    assert repeats(documents([], 1)) == []


def test_merging_shards_equals_sorting(monkeypatch):
    rng = np.random.default_rng(0)
    n = 400
    base = rng.integers(97, 100, (20, suffix_dedup.WIDTH)).astype(np.uint8)
    rows = base[rng.integers(0, 20, n)]
    change = rng.random(rows.shape) < 0.02
    rows = np.where(change, 100, rows).astype(np.uint8)
    far = rng.integers(0, suffix_dedup.REACH + 1, n).astype(np.int16)
    near = (far * rng.random(n)).astype(np.int16)
    owner = rng.integers(0, 1000, n)
    results = []
    for size in (64, 10_000):
        monkeypatch.setattr(suffix_dedup, "SHARD_ROWS", size)
        results.append(suffix_dedup.smallest_owner(rows, far, near, owner))
    assert (results[0] == results[1]).all()
    for d in (0, 7, suffix_dedup.REACH):
        valid = np.flatnonzero((near <= d) & (far >= d))
        start = suffix_dedup.REACH - d
        strings = [rows[i, start : start + suffix_dedup.LENGTH].tobytes() for i in valid]
        for i, s in zip(valid, strings, strict=True):
            assert results[0][d, i] == min(owner[j] for j, t in zip(valid, strings, strict=True) if s == t)


# -- 5: BPE ------------------------------------------------------------------

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_bpe_equals_the_library(documents, odd, prose):
    library = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(3)
    pieces = [" ", "  ", "\n", "\t", "a", "aa", "the", " the", "'s", "'ll", "12", "é", "ß", "日本", "😀", "\x85", "\x1c",
              " ", "　", "!", "...", "<|endoftext|>", "<|endof", "\r\n", "\0", "²", "́", "_", "?!"]
    rows = [*odd, *((100 + i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 30)))) for i in range(400))]
    rows += [(900, "a" * 900), (901, "=" * 3000), (902, " " * 400), (903, prose(300, 4))]
    got = bpe_automaton.digests(documents(rows), VOCABULARY, with_ids=True).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256(text.encode()).hexdigest(), ids))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_bpe_round_trip(documents, odd):
    df = documents(odd)
    back = bpe_automaton.decode(bpe_automaton.encode(df, VOCABULARY), VOCABULARY)
    assert by_id(back, "text") == sorted(((i, t or "") for i, t in odd), key=repr)
    assert bpe_automaton.digests(documents([], 1), VOCABULARY).count() == 0


def test_long_texts_are_cut_only_where_no_token_spans(monkeypatch, prose):
    automaton = bpe_automaton.Automaton.from_file(VOCABULARY)
    text = prose(3000, 9) + "  \n  " + prose(500, 10)
    whole = bpe_automaton.Encoder(automaton).encode(text).tolist()
    monkeypatch.setattr(bpe_automaton, "PIECE", 97)
    assert bpe_automaton.Encoder(automaton).encode(text).tolist() == whole


# -- 6: n-gram join -----------------------------------------------------------


def brute_join(rows, words=4, percent=85):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and rows[a][0] is not None and rows[b][0] is not None:
                if 100 * len(x & y) >= percent * len(x | y):
                    label[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            groups[find(k)] = min(groups.get(find(k), i), i)
    return sorted(((i, len(sets[k]), None if i is None else groups[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def near_copy(text, changes, rng):
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_join_equals_brute_force(documents, odd, prose):
    rng = random.Random(8)
    originals = [prose(rng.randint(30, 200), 50 + i) for i in range(25)]
    boilerplate = prose(30, 999)
    rows = [*((1000 - 3 * i, t) for i, t in enumerate(originals)), *odd]
    for i in range(150):
        text = near_copy(rng.choice(originals), rng.randint(0, 5), rng)
        rows.append((2000 + i, text.upper() if i % 7 == 0 else text + (" " + boilerplate if i % 5 == 0 else "")))
    rows += [(3000, "word"), (3001, "Two  WORDS"), (3002, boilerplate), (3003, boilerplate + " x")]
    df = documents(rows, 6)
    assert by_id(ngram_join.near_duplicates(df), "n_shingles", "component_id") == brute_join(rows)


def test_join_of_one_large_group(documents, prose):
    """More near copies than a block holds, most of them linked only through others."""
    rng = random.Random(4)
    base = prose(120, 31)
    rows = [(i, near_copy(base, rng.randint(0, 4), rng)) for i in range(1300)]
    got = by_id(ngram_join.near_duplicates(documents(rows, 8)), "n_shingles", "component_id")
    assert got == brute_join(rows)


def test_join_empty_table(documents):
    assert ngram_join.near_duplicates(documents([], 1)).count() == 0
    assert ngram_join.near_duplicates(documents([(1, None), (2, "")], 1)).count() == 2


def test_traversal_prunes_nothing_that_links():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(8):
        base = rng.integers(0, 2**63, 60).astype(np.uint64)
        for _ in range(12):
            keep = base[rng.random(60) > 0.08]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, 3).astype(np.uint64)])))
    sets.sort(key=len)
    block = ngram_join.Block(np.arange(len(sets)), np.array([len(s) for s in sets]), np.concatenate(sets), np.arange(len(sets)))
    links = ngram_join.connect(block, block, True, 85)
    union = ngram_join._Union(np.arange(len(sets)))
    for a, b in links:
        union.parent[union.find(a)] = union.find(b)
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            shared = len(np.intersect1d(x, y))
            if 100 * shared >= 85 * (len(x) + len(y) - shared):
                assert union.find(a) == union.find(b)


# -- 7: source mix -------------------------------------------------------------


def brute_targets(sizes):
    weights = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = {s: w for s, w in weights.items() if s not in capped}
        share = {s: rest * w / sum(free.values()) for s, w in free.items()}
        over = {s: 3.0 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return share | capped
        capped |= over


def test_mix(documents, prose):
    rng = random.Random(2)
    source = lambda i: (None, "b", "a", "c", "ä", "Z")[i % 97 % 6 if i % 97 < 60 else 1]
    rows = [(i, prose(rng.choice([0, 1, 5, 40, 120, 900 if i % 50 == 0 else 30]), i)) for i in range(3000)]
    df = documents(rows, 5, source=source)
    got = {r.doc_id: r for r in source_mix.mix(df).collect()}
    sizes, taken = {}, {}
    for i, t in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        assert got[i]["size"] == size and got[i].source == source(i)
        assert got[i].taken in (0, size, 2 * size, 3 * size)
        sizes[source(i)] = sizes.get(source(i), 0) + size
        taken[source(i)] = taken.get(source(i), 0) + got[i].taken
    want = brute_targets(sizes)
    for i, _ in rows:
        assert got[i].source_size == sizes[source(i)]
        assert got[i].target == pytest.approx(want[source(i)], rel=1e-12)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 5, (s, taken[s], want[s])
    again = {r.doc_id: r.copies for r in source_mix.mix(df.repartition(2)).collect()}
    assert again == {i: r.copies for i, r in got.items()}


def test_mix_odd_rows(documents, odd, spark):
    got = source_mix.mix(documents(odd)).collect()
    assert len(got) == len(odd) and sum(r["size"] for r in got if r.doc_id in (1, 2, 3)) == 0
    assert source_mix.mix(documents([], 1)).count() == 0
    nothing = source_mix.mix(documents([(1, None), (2, " ")])).collect()
    assert all((r.target, r.taken) == (0.0, 0) for r in nothing)


def test_targets_cap_in_turn(spark):
    for sizes in ({"a": 10, "b": 10, "c": 1000}, {"a": 5, "b": 0, None: 1}, {"a": 1, "b": 1, "c": 1, "d": 4000, "e": 30}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in source_mix.targets(df).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_flight_keeps_totals():
    rng = np.random.default_rng(6)
    sizes, chances = rng.integers(1, 500, 700), rng.random(700)
    x = source_mix.flight(sizes, chances, "seed")
    assert ((x > 0) & (x < 1)).sum() <= 2
    assert float(sizes @ x) == pytest.approx(float(sizes @ chances)) and x.sum() == pytest.approx(chances.sum())
    landed = source_mix.landing(sizes, x, (chances > 0) & (chances < 1))
    assert set(landed) <= {0.0, 1.0} and abs(float(sizes @ landed) - float(sizes @ chances)) <= 2


# -- 9: licenses ------------------------------------------------------------------


def brute_scan(i, t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base, labels, best = [], set(), 0.0
    for template in license_scan.TEMPLATES:
        a, b = template.key_range
        for at in range(len(words) - (b - a) + 1):
            if words[at : at + b - a] == template.words[a:b]:
                same = sum(0 <= at - a + k < len(words) and words[at - a + k] == w for k, w in enumerate(template.words))
                best = max(best, same / len(template.words))
                labels.add(template.label)
                if template.base:
                    base.append((at, template.label))
    return (
        i, len(words), len(base), min((p for p, _ in base), default=None), max((p for p, _ in base), default=None),
        ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), best,
    )


def test_licenses_equal_brute_force(documents, odd, prose):
    texts = [
        "MIT License", "the mit  license, mit license; MIT-LICENSE", "mit.license mitlicense", "license mit license",
        "Licensed under the Apache License, Version 2.0.", "GNU General Public License version 3 and GNU Lesser General Public License",
        "general general public license license", "Licensed under CC BY-NC 4.0.", "under cc by", "All rights reserved.",
        "Permission is hereby granted, free of charge, to anyone", "Redistribution and use in source and binary forms",
        "MIT\0License", "ümit license", "mit license" * 3, prose(3000, 2) + " apache license " + prose(100, 3) + " mit license",
    ]
    rows = [*odd, *((100 + i, t) for i, t in enumerate(texts))]
    got = license_scan.scan(documents(rows))
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert by_id(got, *columns) == sorted((brute_scan(i, t) for i, t in rows), key=repr)
    assert license_scan.scan(documents([], 1)).count() == 0


# -- 10: lines -----------------------------------------------------------------------


def brute_lines(rows, min_chars=1):
    def norm(line):
        return re.sub(r"[ \t\v\f\r]+", " ", line).strip(" ").lower()

    order = {}
    for i, t in rows:
        for unit, line in enumerate((t or "").split("\n")):
            key = (i is not None, i or 0, unit)
            if len(norm(line)) >= min_chars:
                order[norm(line)] = min(order.get(norm(line), key), key)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for u, x in enumerate(lines) if len(norm(x)) < min_chars or order[norm(x)] == (i is not None, i or 0, u)]
        out.append((i, len((t or "").encode()), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_equal_brute_force(documents, odd, prose):
    rng = random.Random(1)
    pool = [prose(rng.randint(1, 30), 500 + i) for i in range(40)]
    rows = list(odd)
    for i in range(150):
        lines = [rng.choice(pool) if rng.random() < 0.5 else prose(rng.randint(0, 12), 10_000 + 10 * i + k) for k in range(rng.randint(1, 9))]
        rows.append((20 + i, "\n".join(x.upper() + "  " if rng.random() < 0.2 else x for x in lines)))
    got = substring_lines.remove_repeated_lines(documents(rows))
    assert by_id(got, "n_bytes", "n_units", "n_removed_units", "kept") == brute_lines(rows)
    assert substring_lines.remove_repeated_lines(documents([], 1)).count() == 0


def test_line_spans_are_places_in_the_original(documents, prose):
    a, b, c = (prose(12, k) for k in (1, 2, 3))
    got = {r.doc_id: r for r in substring_lines.remove_repeated_lines(documents([(1, f"{a}\n{b}"), (2, f"é{c}\n{a}\n{b}\nend")])).collect()}
    (span,) = got[2].spans
    assert f"é{c}\n{a}\n{b}\nend".encode()[span.start : span.end] == f"{a}\n{b}".encode()
    assert got[2].kept == f"é{c}\nend" and got[1].spans == []


def test_crc32_is_the_usual_one(spark):
    from pyspark.sql import functions as F

    got = spark.range(50).select("id", F.crc32(F.col("id").cast("string").cast("binary")).alias("c")).collect()
    assert all(r.c == zlib.crc32(str(r.id).encode()) for r in got)
