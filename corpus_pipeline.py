"""The corpus pipeline: documents made fit for training, stage by stage.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes what it returns to the
shared folder and hands it, read again, to the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rosterlake.llm import bpe_automaton, ngram_join, source_mix, suffix_dedup, toxicity
from rosterlake.llm.common import read_table, write_and_read
from rosterlake.sources.scratch import scratch_folder, temporary_scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text is predicted toxic go."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: five-word shingles, Jaccard 0.8 or more."""
    return ngram_join.keep_one(docs, words=5, percent=80)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut out of the texts."""
    return suffix_dedup.shorten(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get their target share; a document appears as often as the mix takes it."""
    return source_mix.resample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of what they decode to."""
    return bpe_automaton.digests(docs, bpe_automaton.vocabulary_path(), with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: A trained classifier, byte surgery and balanced sampling are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = scratch_folder(spark, f"stage_{name}")
        with temporary_scratch(spark):  # what a stage wrote on its way goes once its result is written
            docs = write_and_read(stage(spark, docs, sf_dir), name, folder)
    return docs
