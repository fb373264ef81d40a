"""Embedding operators against brute force, and on odd rows and empty tables."""

from __future__ import annotations

import numpy as np
import pytest

from rosterlake.llm import adaptive_scan, embedding_dedup
from rosterlake.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, block string, list string, cluster int"


@pytest.fixture
def vectors(spark):
    def build(rows, partitions: int = 4):
        full = [(i, None if e is None else [None if x is None else float(x) for x in e], l, "b", "l", 1) for i, e, l in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return build


ODD = [
    (900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [1.0, None] + [0.0] * 14, 1),
    (904, [float("nan")] * 16, 1), (905, [float("inf")] + [0.0] * 15, 1), (906, [1.0] * 16, None),
    (907, [1.0] * 16, None), (None, [1.0] * 16, 1), (908, [1.0] * 4, 1), (909, [2.0] * 4, 1),
]


def clustered(n, seed, width=16, spread=0.03):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    rows = []
    for i in range(n):
        c = rng.integers(12)
        v = centres[c] + rng.normal(size=width) * (spread if c < 6 else 1.0)
        rows.append([i, (v * rng.uniform(0.1, 9)).astype(np.float32), int(c % 3)])
    for i in range(0, n, 9):
        rows[i][1] = rows[0][1]  # equal vectors, some under other labels
    return [tuple(r) for r in rows]


def good(e):
    return e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(x != 0 for x in e)


def brute_links(rows, cosine=0.98):
    units = [np.asarray(e, float) / np.linalg.norm(np.asarray(e, float)) if good(e) else None for _, e, _ in rows]
    label, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, (ia, _, la) in enumerate(rows):
        for b in range(a):
            ib, _, lb = rows[b]
            if None in (ia, ib, la, lb) or la != lb or units[a] is None or units[b] is None or len(units[a]) != len(units[b]):
                continue
            if units[a] @ units[b] >= cosine:
                links[a] += 1
                links[b] += 1
                label[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, links[k], least.get(find(k))) for k, (i, _, _) in enumerate(rows)), key=repr)


def test_dedup_equals_brute_force(vectors):
    rows = clustered(900, 1) + [(i, None if e is None else e, l) for i, e, l in ODD]
    got = embedding_dedup.near_duplicates(vectors(rows), block_rows=70).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == brute_links(
        [(i, None if e is None else [None if x is None else np.float32(x) for x in e], l) for i, e, l in rows]
    )
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_dedup_of_chains(vectors):
    """Vectors on an arc: each links with its neighbours only, all are one component."""
    angles = np.arange(300) * 0.15
    rows = [(i, [np.cos(a % 6.2), np.sin(a % 6.2), 0.0], 1) for i, a in enumerate(angles[:41])]
    got = embedding_dedup.near_duplicates(vectors(rows), block_rows=8).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == brute_links([(i, np.float32(e), l) for i, e, l in rows])


def test_dedup_without_vectors(vectors):
    assert embedding_dedup.near_duplicates(vectors([], 1)).count() == 0
    got = embedding_dedup.near_duplicates(vectors(ODD[:6])).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, 0, i, True) for i in range(900, 906)}


def test_grid_join_finds_all_links():
    rng = np.random.default_rng(5)
    u = embedding_dedup._normalised(np.repeat(rng.normal(size=(30, 8)), 15, axis=0) + rng.normal(size=(450, 8)) * 0.08)
    eps = np.sqrt(2 - 2 * 0.98) * (1 + 1e-9)
    cells = np.floor(u[:, :3] / eps).astype(np.int32)
    order = np.lexsort(cells.T[::-1])
    s = embedding_dedup._Sequence(order, np.ones(450), cells[order], u[order])
    found = {(i, j) for x, y in embedding_dedup.join_sequences(s, s, True, 0.98) for i, j in zip(x, y, strict=True)}
    want = np.argwhere(np.triu(u[order] @ u[order].T >= 0.98, 1))
    assert found == set(map(tuple, want))


def brute_nearest(rows, k, every):
    usable = {i: np.asarray(e, float) for i, e, _ in rows if i is not None and good(e)}
    out = {}
    for q, v in usable.items():
        if q % every == 0:
            scores = sorted(((-float((v * w).sum()), i) for i, w in usable.items() if i != q and len(w) == len(v)))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_nearest_recall(vectors):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=24) * rng.uniform(0.5, 2), 0) for i in range(4000)]
    rows = [(i, np.float32(e), l) for i, e, l in rows]
    got = adaptive_scan.nearest(vectors(rows)).collect()
    want = brute_nearest(rows, 20, 20)
    mine = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        mine.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(mine) == set(want) and all(len(v) == 20 for v in mine.values())
    hits = sum(len({i for i, _ in mine[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, found in mine.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(s == pytest.approx(float((rows[q][1].astype(float) * rows[i][1]).sum())) for i, s in found)


def test_nearest_few_ties_and_odd_rows(vectors):
    one = np.float32([1.0] + [0.0] * 15)
    rows = [(i, one, 0) for i in range(0, 12)] + [(20, one * 2, 0)] + ODD + [(20, one * 2, 0)]
    got = adaptive_scan.nearest(vectors(rows)).collect()
    found = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 20, 900)}
    want = brute_nearest([r for r in rows if r[0] != 20] + [(20, one * 2, 0)], 20, 20)
    assert found[0] == want[0] and found[20] == want[20] and found[900] == []
    assert adaptive_scan.nearest(vectors([], 1)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(7)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(200)]
    links += [(5000, 5001 + i) for i in range(300)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for pair in links for x in pair}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in label}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
