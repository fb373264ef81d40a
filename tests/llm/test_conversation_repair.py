"""Conversation repair against a search through all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from rosterlake.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, word string, audit string, n long"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def search(rows, found):
    """The least (cost, audit) over every sequence of edits, by trying them all up to the best cost."""
    best = [3 * len(rows), "D" * len(rows), []]

    def go(i, cost, audit, out, inserted):
        if cost > best[0]:
            return
        roles = "".join(r[:1] for r, _ in out)
        if not re.fullmatch("s?(ua)*u?", roles):
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", roles) and all(r for r, _ in out) and (cost, audit) < (best[0], best[1]):
                best[:] = [cost, audit, out]
        else:
            _, _, role, text = rows[i]
            go(i + 1, cost + 3, audit + "D", out, 0)
            if found[i] not in ("blank", "duplicate"):
                more = found[i] == "truncated"
                if role[:1] in "sua" and role:
                    go(i + 1, cost + more, audit + "K", [*out, (role, text)], 0)
                for new in ("user", "assistant"):
                    go(i + 1, cost + 2 + more, audit + "R", [*out, (new, text)], 0)
        if inserted < 2:
            for new in ("user", "assistant"):
                go(i, cost + 2, audit + "I", [*out, (new, "")], inserted + 1)

    go(0, 0, "", [], 0)
    return best


def brute(rows, ids):
    out = []
    for conv in ids:
        mine = [r for r in rows if r[0] == conv]
        found = faults(mine)
        cost, audit, repaired = search(mine, found)
        turns = [r[1] for r in mine if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:], strict=False)]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append(
            (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
             *[found.count(f) for f in ("blank", "duplicate", "truncated")],
             sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
        )
    return sorted(out, key=str)


def conversations(seed, n):
    rng, rows = random.Random(seed), []
    texts = ["Hi.", "Yes!", "cut off", "Hi.", " ", "", "more?\n", "é.", None, "x" * 3000 + "."]
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            turn = None if rng.random() < 0.1 else turn + rng.randint(0, 1)
            rows.append((conv, turn, role, rng.choice(texts)))
    return rows


@pytest.mark.parametrize("bits", [1, 10])
def test_repair_equals_search(spark, monkeypatch, tmp_path, bits):
    monkeypatch.setattr(cr, "SEGMENT_BITS", bits)  # 1: conversations of several segments
    rows = conversations(bits, 150)
    table = spark.createDataFrame([(*r, "w", "a", 7) for r in rows], SCHEMA).repartition(5)
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    got = cr.op11_conversation_repair(spark, str(tmp_path))
    ids = {r[0] for r in rows}
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == brute(damaged(rows), ids)


def test_one_long_conversation_over_many_segments(spark):
    """A conversation that holds most rows: its audit follows the plain left-to-right reading."""
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), f"t{i}" + rng.choice([".", ""])) for i in range(5000)]
    found, repaired = cr.repair(spark.createDataFrame([*rows, (2, 0, "user", "a.")], "conv_id long, turn long, role string, text string"))
    one, two = found.orderBy("conv_id").collect()
    best = {0: (0, "")}
    for row, fault in zip(rows, faults(rows), strict=True):
        matrix, after = cr.terminal(row[2][0].upper() if fault else row[2][0]), {}
        for state, (cost, audit) in best.items():
            for end, (more, edits) in matrix[state].items():
                after[end] = min(after.get(end, (10**9, "")), (cost + more, audit + edits))
        best = after
    ends = {0: 0, 3: 0, 2: 1, 1: 2}
    assert (one.cost, one.audit) == min((c + 2 * ends[s], a + "I" * ends[s]) for s, (c, a) in best.items())
    assert (two.cost, two.audit) == (2, "KI")
    said = [r.role[0] for r in repaired.filter("conv_id = 1").orderBy("place").collect()]
    assert re.fullmatch("s?(ua)+", "".join(said))


def test_many_equal_rows_are_one_run(spark):
    rows = [(1, 0, "user", "same.")] * 3000 + [(1, 1, "assistant", "ok.")]
    found, _ = cr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    one = found.first()
    assert (one.duplicate, one.cost, one.audit, one.illegal) == (2999, 3 * 2999, "D" * 0 + "K" + "D" * 2999 + "K", 2999)


def test_grammar_gives_the_products_of_single_rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("suadUA") for _ in range(rng.randint(1, 40))) for _ in range(200)] + ["ua" * 200, "dddd" * 30]
    rules, coded = cr.compress(words, 2)
    assert rules and sum(map(len, coded)) < sum(map(len, words)) / 2
    for word, matrix in zip(words, cr.solve(words, 2), strict=True):
        plain = cr.terminal(word[0])
        for symbol in word[1:]:
            plain = cr.product(plain, cr.terminal(symbol))
        assert [{j: (c, cr.spell(a)) for j, (c, a) in row.items()} for row in plain] == [
            {j: (c, cr.spell(a)) for j, (c, a) in row.items()} for row in matrix
        ]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert cr.op11_conversation_repair(spark, str(tmp_path)).count() == 0
