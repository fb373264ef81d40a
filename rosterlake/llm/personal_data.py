"""Personal data by anchor expansion.

An Aho-Corasick automaton reads each text once and reports anchors: at-signs, plus signs,
digits, ``://`` and cue words such as "IBAN" or "account". At an anchor a local parser that
never backs up over more than one run of characters finds where the address or number
begins and ends, and validates it (labels of a domain, parts of an address, check digits).
Text without anchors costs nothing beyond the automaton's pass.

Four kinds have fixed grammars (``BASE``); a parser gives exactly the leftmost,
non-overlapping matches of its kind's grammar and drops those that fail validation.
Three further kinds are found by scheme and by cue: logins in web addresses, IBANs and
numbers that a cue word calls an account. Kinds do not block each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.common import give_back, read_table, text_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account")

IBAN_CUES = ("iban", "Iban", "IBAN")
ACCOUNT_CUES = ("account", "Account", "ACCOUNT", "passport", "Passport", "PASSPORT")

#: Texts are handed to the parsers in parts of about so many bytes.
PART_BYTES = 4 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_SPACED = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USER = re.compile(r"[^\x00-\x20/?#@:]++(?::[^\x00-\x20/?#@]*+)?@[A-Za-z0-9.-]+")
_IBAN = re.compile(r"[:#=. ]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?: no| number)?[.:#=]? {0,2}([0-9](?:[ -]?[0-9]){5,19})")

Span = tuple[str, int, int]


@cache
def _anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for digit in "0123456789":
        automaton.add_word(digit, ("number", 1))
    automaton.add_word("@", ("email", 1))
    automaton.add_word("+", ("phone", 1))
    automaton.add_word("://", ("login", 3))
    for cue in IBAN_CUES:
        automaton.add_word(cue, ("iban", len(cue)))
    for cue in ACCOUNT_CUES:
        automaton.add_word(cue, ("account", len(cue)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the right counts twice."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(said: str) -> str:
    return re.sub("[^0-9]", "", said)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _iban_ok(said: str) -> bool:
    plain = said.replace(" ", "")
    turned = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _run_before(text: str, at: int, floor: int, letters: frozenset) -> int:
    while at > floor and text[at - 1] in letters:
        at -= 1
    return at


def find_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points, by kind as in ``KINDS``, then by start."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where the search for each kind goes on
    for last, (cue, size) in _anchors().iter(text):
        at, after = last + 1 - size, last + 1
        if cue == "number":
            if at >= done["ip"]:
                chain = _DOTTED.match(text, at)
                done["ip"] = chain.end()
                parts, begin = chain[0].split("."), at
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    end = begin + sum(map(len, four)) + 3
                    if all(map(_small, four)):
                        found["ip"].append((begin, end))
                    begin = end + 1
            if at >= done["card"]:
                chain = _SPACED.match(text, at)
                done["card"] = chain.end() if chain else after
                if chain:
                    digits = _digits(chain[0])
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(chain.span())
        elif cue == "email":
            domain = _DOMAIN.match(text, after) if at >= done["email"] else None
            begin = _run_before(text, at, done["email"], _LOCAL) if domain else at
            if begin < at:
                found["email"].append((begin, domain.end()))
                done["email"] = domain.end()
        elif cue == "phone":
            number = _PHONE.match(text, at) if at >= done["phone"] else None
            if number:
                done["phone"] = number.end()
                if 8 <= len(_digits(number[0])) <= 15:
                    found["phone"].append(number.span())
        elif cue == "login":
            user = _USER.match(text, after) if at >= done["login"] else None
            begin = _run_before(text, at, done["login"], _SCHEME) if user else at
            while begin < at and not text[begin].isalpha():  # a scheme begins with a letter
                begin += 1
            if begin < at:
                found["login"].append((begin, user.end()))
                done["login"] = user.end()
        else:
            number = (_IBAN if cue == "iban" else _ACCOUNT).match(text, after) if at >= done[cue] else None
            if number:
                done[cue] = number.end()
                if cue == "account" or _iban_ok(number[1]):
                    found[cue].append(number.span(1))
    return [(kind, a, b) for kind in KINDS for a, b in found[kind]]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("said", pa.string())]))


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, _, _ in text_batches(batch, "text", PART_BYTES):
            spans = [
                [{"kind": k, "start": a, "end": b, "said": text[a:b]} for k, a, b in find_spans(text or "")]
                for text in part.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, _SPANS)], names=["doc_id", "spans"])
    give_back()


def find_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id and spans, an array of (kind, start, end, said).

    Positions are code points, ``end`` exclusive; spans come by kind as in ``KINDS``, then
    by start. Rows are judged one by one, so repeated rows and rows that share a doc_id give
    a row each. A NULL or empty text has no spans, a NULL doc_id stays NULL, an empty table
    gives none. Texts of any length are read whole; other columns are ignored. Of two
    matches of a kind that overlap the one that begins first counts; kinds may overlap.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(
        _expand, "doc_id long, spans array<struct<kind:string,start:long,end:long,said:string>>"
    )


def _of(kinds: tuple[str, ...]) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[F.size(_of((kind,))).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(_joined(_of(BASE)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def _places(kind: str, pattern: str, checked: str, group: int = 0) -> str:
    """SQL: a row per text with its valid spans of a kind, from the matches and what lies between them."""
    said = pattern.replace("'", "''")
    return f"""
  SELECT k, '{kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
           'a': list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)
                + length(m[i]) - length(g[i]),
           'z': list_sum(list_transform(b[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))),
           'said': g[i] }}), lambda s: {checked})) AS s
  FROM (SELECT k, regexp_extract_all(t, '{said}') AS m, regexp_extract_all(t, '{said}', {group}) AS g,
               regexp_split_to_array(t, '{said}') AS b FROM texts)"""


_DIGITS_SQL = "regexp_replace(s.said, '[^0-9]', '', 'g')"
_LUHN_SQL = (
    f"list_sum(list_transform(range(1, length({_DIGITS_SQL}) + 1), lambda j: list_extract([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9],"
    f" 1 + substr(reverse({_DIGITS_SQL}), j, 1)::INT + CASE WHEN j % 2 = 0 THEN 10 ELSE 0 END))) % 10 = 0"
)
_TURNED_SQL = "substr(replace(s.said, ' ', ''), 5) || substr(replace(s.said, ' ', ''), 1, 4)"
_IBAN_SQL = (
    f"list_reduce(list_prepend(0, list_transform(string_split(array_to_string(list_transform(string_split({_TURNED_SQL}, ''),"
    " lambda c: CASE WHEN c >= 'A' THEN (ascii(c) - 55)::VARCHAR ELSE c END), ''), ''), lambda d: d::INT)), lambda x, d: (x * 10 + d) % 97) = 1"
)
_SMALL_SQL = "len(list_filter(string_split(s.said, '.'), lambda p: length(ltrim(p, '0')) > 3 OR ('0' || right(p, 3))::INT > 255)) = 0"

ORACLE = f"""
WITH texts AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), places AS ({" UNION ALL ".join([
    _places("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+", "true"),
    _places("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", _SMALL_SQL),
    _places("card", r"[0-9](?:[\x20\-]?[0-9])+", f"length({_DIGITS_SQL}) BETWEEN 16 AND 19 AND {_LUHN_SQL}"),
    _places("phone", r"\+[0-9][\x20().0-9\-]+[0-9]", f"length({_DIGITS_SQL}) BETWEEN 8 AND 15"),
    _places("login", r"[A-Za-z][A-Za-z0-9+.\-]*://[^\x00-\x20/?#@:]+(?::[^\x00-\x20/?#@]*)?@[A-Za-z0-9.\-]+", "true"),
    _places("iban", rf"(?:{'|'.join(IBAN_CUES)})[:#=. ]{{0,3}}([A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}})", _IBAN_SQL, 1),
    _places("account", rf"(?:{'|'.join(ACCOUNT_CUES)})(?: no| number)?[.:#=]? {{0,2}}([0-9](?:[ \-]?[0-9]){{5,19}})", "true", 1),
])}
), listed AS (
  SELECT k, kind, list_position({list(KINDS)}, kind) AS place, s.a::BIGINT AS a,
         kind || ':' || s.a::BIGINT || ':' || s.z::BIGINT AS said FROM places
), per_text AS (
  SELECT k, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in BASE)},
         string_agg(said, ',' ORDER BY place, a) FILTER (place <= {len(BASE)}) AS base,
         string_agg(said, ',' ORDER BY place, a) AS spans
  FROM listed GROUP BY k
)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN per_text USING (k)
"""
