"""Personal data against plain regular expressions."""

from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import documents, odd, prose  # noqa: F401
from rosterlake.llm.personal_data import find_personal, find_spans, luhn, op13_personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "login": r"[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20/?#@:]+(:[^\x00-\x20/?#@]*)?@[A-Za-z0-9.-]+",
    "account": r"(?:account|Account|ACCOUNT|passport|Passport|PASSPORT)(?: no| number)?[.:#=]? {0,2}(?P<said>[0-9](?:[ -]?[0-9]){5,19})",
}


def plain_luhn(digits: str) -> bool:
    doubled = [int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def brute(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PATTERNS.items():
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match[0])
            if kind == "ip" and max(int(p) for p in match[0].split(".")) > 255:
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *match.span("said" if kind == "account" else 0)))
    return out


PIECES = st.sampled_from(
    ["@", ".", "a", "Zé", "x-1", "%+", " ", "-", "1", "25", "300", "4111111111111111", "+1 (", "555)", "://", "http", ":",
     "/", "account", " no", "Passport", "😀", "\n", "00192.168", "12.5.6.7", "a@b.c", "ñ"]
)


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, max_size=40).map("".join))
def test_spans_equal_regular_expressions(text):
    assert [s for s in find_spans(text) if s[0] != "iban"] == brute(text)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="0123456789 -.+()@ab:/", max_size=80))
def test_spans_of_dense_text(text):
    assert [s for s in find_spans(text) if s[0] != "iban"] == brute(text)


def test_check_digits():
    assert luhn("4111111111111111") and not luhn("4111111111111112") and luhn("0")
    good, bad = "pay IBAN: GB82 WEST 1234 5698 7654 32 now", "IBAN GB82 WEST 1234 5698 7654 33"
    assert [s for s in find_spans(good) if s[0] == "iban"] == [("iban", 10, 37)]
    assert not [s for s in find_spans(bad) if s[0] == "iban"]


def test_long_runs_take_linear_time():
    size = 400_000
    for text in ("a" * size + "@", "@" * size, "1." * size, "1 " * size, "+1" * size, "a@" * size, "+1" + " " * size):
        assert [s for s in find_spans(text) if s[0] in ("login", "iban", "account")] == []


def test_table_with_odd_rows(spark, documents, odd):
    rows = [*odd, (20, "mail an.ñ x.y@z.example.com, 10.0.0.300 10.0.0.30"), (21, "z " * 60_000 + "+49 30 1234567")]
    got = sorted(tuple(r) for r in find_personal(documents(rows)).select("doc_id", "spans").collect() if r[0] is not None)
    want = sorted(
        (i, [(k, a, b, t[a:b]) for k, a, b in brute(t or "")] if t else []) for i, t in rows if i is not None
    )
    assert [(i, [tuple(s) for s in spans]) for i, spans in got] == want
    assert find_personal(documents(rows)).count() == len(rows)
    assert find_personal(documents(rows).limit(0)).count() == 0


def test_digest_columns(spark, documents, tmp_path):
    text = "a@b.cd 1.2.3.4 +1 (222) 555-1234, 4111 1111 1111 1111 x://u:p@h a+b@c.d"
    documents([(1, text), (2, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    one, two = op13_personal_data(spark, str(tmp_path)).orderBy("doc_id").collect()
    spans = [f"{k}:{a}:{b}" for k, a, b in brute(text)]
    base = ",".join(s for s in spans if not s.startswith("login"))
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (2, 1, 1, 1)
    assert one.spans == ",".join(spans) and "login" in one.spans
    assert one.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert (two.n_email, two.spans, two.base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
