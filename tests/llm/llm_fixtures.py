from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, bucket int, n string, row string, label string, unit string"


@pytest.fixture
def documents(spark):
    """``documents([(doc_id, text), …])``: a table with extra columns whose names operators use inside."""

    def build(rows, partitions: int = 3, lang="en", source=None):
        full = [
            (i, t, lang(i) if callable(lang) else lang, source(i) if callable(source) else source or "a",
             len(t or ""), "b", 7, "n", "r", "l", None)
            for i, t in rows
        ]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return build


@pytest.fixture
def prose():
    """``prose(n, seed)``: words made of syllables."""

    def build(n: int, seed: int, syllables=("an", "er", "th", "ou", "re", "ti", "ha", "lo", "zé", "mi")) -> str:
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    return build


#: NULLs, empty, blank, short, very long, repeated rows, a NULL id, characters of several bytes.
@pytest.fixture
def odd(prose):
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, "two words"), (6, prose(40_000, 1)),
        (7, "same row"), (7, "same row"), (None, "no id"), (None, None), (8, "日本語 😀 ñandú"), (9, "x" * 5000),
    ]
