"""Links of the n-gram join against brute force."""

from __future__ import annotations

import random

from llm_fixtures import documents, odd, prose  # noqa: F401
from test_text_operators import by_id, near_copy

from rosterlake.llm import ngram_join


def brute_links(rows, words=4, percent=85):
    """Rows (doc_id, n_links, component_id); every row is a document of its own."""
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w and i is not None else set())
    near = [[b for b, y in enumerate(sets) if a != b and x and 100 * len(x & y) >= percent * len(x | y)] for a, x in enumerate(sets)]
    out = []
    for a, (i, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        out.append((i, len(near[a]), None if i is None else min(rows[b][0] for b in seen)))
    return sorted(out, key=repr)


def test_links_equal_brute_force(documents, odd, prose):
    rng = random.Random(12)
    base, other = prose(120, 31), prose(60, 32)
    rows = [*odd, *((100 + i, near_copy(base, rng.randint(0, 4), rng)) for i in range(700))]
    rows += [(900 + i, base) for i in range(5)] + [(910 + i, near_copy(other, i % 3, rng)) for i in range(9)]
    rows += [(50, base), (50, other), (50, other), (None, base)]
    got = by_id(ngram_join.near_duplicates(documents(rows, 6)), "n_links", "component_id")
    assert got == brute_links(rows)
    assert max(n for _, n, _ in got) > 100


def test_links_between_blocks_that_are_no_neighbours(documents, prose):
    rng = random.Random(3)
    base = prose(40, 5)
    rows = [(i, near_copy(base, rng.randint(0, 1), rng)) for i in range(2 * ngram_join.BLOCK_ROWS + 200)]
    got = by_id(ngram_join.near_duplicates(documents(rows, 4)), "n_links", "component_id")
    assert got == brute_links(rows)


def test_crowded_bands_lose_no_link(documents, prose, monkeypatch):
    monkeypatch.setattr(ngram_join, "BAND_BLOCKS", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 600)
    rng = random.Random(8)
    bases = [prose(n, 50 + n) for n in (12, 40, 46, 52, 70)]
    rows = [(i, near_copy(bases[i % 5], rng.randint(0, 2), rng)) for i in range(400)]
    # Sizes that run through several bands, each text a few words longer than the one before.
    rows += [(1000 + i, " ".join(prose(400, 9).split()[: 60 + 4 * i])) for i in range(80)]
    got = by_id(ngram_join.near_duplicates(documents(rows, 4)), "n_links", "component_id")
    assert got == brute_links(rows)
