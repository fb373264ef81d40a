"""Each stage of the pipeline on its own input, against brute force on a small folder."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from llm_fixtures import documents, prose  # noqa: F401
from test_text_operators import VOCABULARY, brute_join, brute_repeats, near_copy
from pyspark.sql import functions as F
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def folder(spark, documents, prose, tmp_path):
    rng = random.Random(6)
    base = [prose(rng.randint(20, 90), i) for i in range(40)]
    passage = prose(60, 999)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, near_copy(rng.choice(base), rng.randint(0, 1), rng)) for i in range(60)]
    rows += [(300 + i, f"{prose(25, 3000 + i)}\n{passage}\n{prose(20, 4000 + i)}") for i in range(20)]
    rows += [(400 + i, f"{prose(20, 5000 + i)} idiot moron {prose(9, 6000 + i)}") for i in range(60)]
    rows += [(500, None), (501, ""), (502, "same"), (502, "same"), (None, "no id"), (503, prose(300, 7))]
    rows += [(None, base[1]), (None, "no id"), (None, None)]
    df = documents(rows, 4, source=lambda i: f"s{(i or 0) % 3}")  # its further columns have names that stages use inside
    for i, name in enumerate(("copies", "copy", "mix_row", "kept", "spans", "n_bytes", "rest", "there", "its", "number", "place")):
        df = df.withColumn(name, F.lit(f"{i} own"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(400 <= i < 500), 1) for i, _ in rows if i is not None]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs, stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = (before, docs)
        if name != "bpe":
            assert docs.columns == columns

    before, after = seen["toxicity"]
    ids = {r.doc_id for r in after.collect()}
    assert not ids & set(range(400, 460)) and ids >= set(range(40)) | {500, 501, 502, 503, None}

    before, after = seen["ngram_join"]
    rows = sorted(before.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    keep = {i for i, _, c in brute_join([(i, r.text) for i, r in enumerate(rows)], 5, 80) if i == c}
    assert plain(after) == sorted((tuple(r) for i, r in enumerate(rows) if i in keep), key=repr)
    said = [(r.doc_id, r.text) for r in after.collect()]
    assert said.count((502, "same")) == 1 and said.count((None, "no id")) == 1 and (None, None) in said

    before, after = seen["suffix_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = [(i, kept.decode("utf-8", "ignore")) for i, _, _, kept in brute_repeats(rows)]
    assert plain(after.select("doc_id", "text")) == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = seen["source_mix"]
    size = lambda t: len((t or "").split())
    total = sum(size(r.text) for r in before.collect())
    assert sum(size(r.text) for r in after.collect()) == pytest.approx(total, rel=0.02)
    assert set(plain(after)) <= set(plain(before))
    assert max(plain(after).count(x) for x in set(plain(after))) <= 3
    assert {r.copies for r in after.collect()} == {"0 own"} and {r.mix_row for r in after.collect()} == {"2 own"}

    before, after = seen["bpe"]
    library, want = Tokenizer.from_file(VOCABULARY), []
    for r in before.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((r.doc_id, len(ids), digest, hashlib.sha256((r.text or "").encode()).hexdigest(), ids))
    assert plain(after) == sorted(want, key=repr)


def test_empty_documents(spark, folder, tmp_path):
    other = tmp_path / "empty"
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(other / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(str(other / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(other)).count() == 0
