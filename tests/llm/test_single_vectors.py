"""Embedding dedup of tables that hold one distinct vector."""

from __future__ import annotations

from test_vector_operators import vectors  # noqa: F401

from rosterlake.llm import embedding_dedup


def test_one_vector(vectors):
    (row,) = embedding_dedup.near_duplicates(vectors([(7, [0.5, 1.0, 2.0], 1)])).collect()
    assert (row.vec_id, row.n_links, row.component_id, row.kept) == (7, 0, 7, True)


def test_nothing_but_copies(vectors):
    rows = [(i, [0.5, 1.0, 2.0], 1) for i in range(3, 8)]
    got = embedding_dedup.near_duplicates(vectors(rows)).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, 4, 3, i == 3) for i in range(3, 8)}
