"""License scans by a positional rare-token index, in DataFrame expressions only.

A licence is known by templates: its usual wording, and within it a key phrase that must
stand word for word. The document frequency of all template words is counted over the
whole corpus; each key phrase is then looked up by its two words of highest IDF. A file's
postings of these words are intersected by relative position, and only where both stand
in the right distance is the key phrase verified and the wording around it compared.
Templates are a handful of constants, so nothing is joined or shuffled but the counts.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.common import read_table


@dataclass(frozen=True)
class Template:
    """``wording`` of a licence; words ``key`` (first, behind last) are mandatory."""

    label: str
    wording: str
    key: tuple[int, int] | None = None
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.wording.split()

    @property
    def key_range(self) -> tuple[int, int]:
        return self.key or (0, len(self.words))


# The phrases asked for, and common wordings of further licences.
TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("apache", "licensed under the apache license version 2 0", (3, 8)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", (0, 8)),
    Template("cc-by", "licensed under cc by", (1, 4)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", (2, 5)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", (2, 5)),
    Template("gpl", "this work is licensed under the gnu general public license version 3", (6, 10)),
    Template("lgpl", "gnu lesser general public license", (1, 5)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", (0, 7)),
    Template("mit", "released under the mit license", (2, 5)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", (11, 14)),
    Template("proprietary", "all rights reserved"),
    Template("public-domain", "released into the public domain", (2, 5)),
)

_WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; an empty array for NULL."""
    pieces = F.split(lower_ascii(F.coalesce(text, F.lit(""))), _WORD_GAP)
    return F.array_remove(pieces, "")


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and of documents with each template word (bounded: the templates')."""
    vocabulary = sorted({w for t in TEMPLATES for w in t.words})
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = docs.select(F.array_intersect(words_of(F.col(text)), known).alias("w"))
    # The marker "" counts the documents themselves: one pass for all figures.
    counted = (
        found.select(F.explode(F.concat(F.array(F.lit("")), F.col("w"))).alias("word"))
        .groupBy("word")
        .count()
        .collect()
    )
    counts = {r["word"]: r["count"] for r in counted}
    return counts.pop("", 0), {w: counts.get(w, 0) for w in vocabulary}


def rare_words(template: Template, n_docs: int, df: dict[str, int]) -> list[tuple[str, int]]:
    """The key phrase's two words of highest IDF and their place in the key phrase."""
    first, last = template.key_range
    words = list(enumerate(template.words[first:last]))
    idf = {w: math.log((1 + n_docs) / (1 + df[w])) for _, w in words}
    chosen = sorted(words, key=lambda x: (-idf[x[1]], x[0]))[:2]
    return [(w, place) for place, w in chosen]


def _places(hits: Column, words: Column, template: Template, rare: list[tuple[str, int]]) -> Column:
    """Starts of a template's key phrase: postings intersected by position, then verified."""
    first, last = template.key_range
    key = F.array(*[F.lit(w) for w in template.words[first:last]])
    (word, place), (other, other_place) = rare[0], rare[-1]
    starts = F.transform(
        F.filter(hits, lambda h: h["w"] == word), lambda h: h["p"] - F.lit(place)
    )
    others = F.transform(
        F.filter(hits, lambda h: h["w"] == other), lambda h: h["p"] - F.lit(other_place)
    )
    both = F.array_intersect(starts, others)
    return F.filter(
        both,
        lambda s: (s >= 0) & (F.slice(words, F.greatest(s, F.lit(0)) + 1, last - first) == key),
    )


def _likeness(places: Column, words: Column, template: Template) -> Column:
    """Largest share of the wording that stands in place around a key phrase; 0 without one."""
    first, _ = template.key_range
    total = len(template.words)
    whole = F.array(*[F.lit(w) for w in template.words])

    def share(start: Column) -> Column:
        same = F.filter(
            F.transform(whole, lambda w, i: F.get(words, start - F.lit(first) + i) == w),
            lambda x: x,
        )
        return F.size(same) / F.lit(total)

    return F.coalesce(F.array_max(F.transform(places, share)), F.lit(0.0))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``, with the licences its text names.

    ``n_words``; ``n_base``, all places of the base phrases; ``first_word`` and
    ``last_word``, their smallest and largest start; ``base_labels`` and ``labels``,
    distinct, sorted, joined by commas ('' without any); ``score``, the largest share of a
    template's wording found in place; ``places``, (label, word) of every key phrase.

    NULL and empty texts have 0 words, NULL starts, '' labels and score 0. Repeated rows
    give repeated results. Only the two named columns are read.
    """
    n_docs, df = document_frequencies(docs, text)
    rare = [rare_words(t, n_docs, df) for t in TEMPLATES]
    lookup = sorted({w for r in rare for w, _ in r})
    words = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
    hits = F.filter(
        F.transform(
            F.col("words"),
            lambda w, i: F.when(w.isin(lookup), F.struct(w.alias("w"), i.alias("p"))),
        ),
        lambda h: h.isNotNull(),
    )
    indexed = words.withColumn("hits", hits)
    found = F.array(
        *[
            F.struct(
                F.lit(t.label).alias("label"),
                F.lit(t.base).alias("base"),
                places.alias("places"),
                _likeness(places, F.col("words"), t).alias("likeness"),
            )
            for t, r in zip(TEMPLATES, rare, strict=True)
            for places in [_places(F.col("hits"), F.col("words"), t, r)]
        ]
    )
    none = F.array().cast("array<struct<label:string,base:boolean,places:array<int>,likeness:double>>")
    looked = indexed.select(
        "doc_id",
        F.size("words").alias("n_words"),
        F.when(F.size("hits") > 0, F.filter(found, lambda f: F.size(f["places"]) > 0))
        .otherwise(none)
        .alias("found"),
    )
    base = F.filter("found", lambda f: f["base"])
    starts = F.flatten(F.transform(base, lambda f: f["places"]))

    def joined(x: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda f: f["label"]))), ",")

    return looked.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["likeness"])), F.lit(0.0)).alias("score"),
        F.flatten(
            F.transform(
                "found",
                lambda f: F.transform(f["places"], lambda p: F.struct(f["label"].alias("label"), p.alias("word"))),
            )
        ).alias("places"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).drop("places")


def _oracle() -> str:
    """Plain positions of all words, every template tried at every place."""
    rows = ",\n    ".join(
        f"({n}, '{t.label}', {str(t.base).lower()}, {i}, '{w}', {t.key_range[0]}, {t.key_range[1]}, {len(t.words)})"
        for n, t in enumerate(TEMPLATES)
        for i, w in enumerate(t.words)
    )
    return f"""
WITH lists AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), template(t, label, base, place, word, key_from, key_to, total) AS (VALUES
    {rows}
), postings AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS p FROM lists
), tried AS (
  SELECT doc_id, t, any_value(label) AS label, any_value(base) AS base, p - place AS start,
         any_value(key_from) AS key_from, any_value(key_to) AS key_to, any_value(total) AS total,
         count(*) FILTER (place >= key_from AND place < key_to) AS key_found, count(*) AS found
  FROM postings JOIN template USING (word) GROUP BY doc_id, t, p - place
), places AS (
  SELECT doc_id, label, base, start + key_from AS word, found::DOUBLE / total AS likeness
  FROM tried WHERE key_found = key_to - key_from
), per_doc AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(word) FILTER (base) AS first_word,
         max(word) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(likeness) AS score
  FROM places GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
       first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM lists LEFT JOIN per_doc USING (doc_id)
"""


ORACLE = _oracle()
