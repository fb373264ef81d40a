"""Rules that judge rows in order, against plain loops over the rows."""

from __future__ import annotations

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rosterlake import labels
from rosterlake.operators import guards
from rosterlake.operators.hierarchy import hierarchy_violations
from rosterlake.operators.patches import apply_checked_updates
from rosterlake.sources import intake


def brute_budget(requests, room):
    left, refused = dict(room), []
    for no, place, need, take in sorted(requests):
        if place in left and need > left[place]:
            refused.append(no)
        elif place in left:
            left[place] -= max(take, 0)
    return refused


@pytest.mark.parametrize("seed,block", [(1, 65536), (2, 7)])
def test_budget_in_order(spark, monkeypatch, seed, block):
    monkeypatch.setattr(guards, "BLOCK_ROWS", block)
    monkeypatch.setattr(guards, "AT_ONCE", 100_000 if block > 1000 else 20)
    rng = random.Random(seed)
    room = {1: 1_000_000, 2: 0, 3: -50, 4: 7, 5: 2**40, 6: 2**20 - 1, 7: 2**20}
    requests = []
    for no in range(900):  # a third of them want the same department
        need = rng.choice([0, 1, 3, 2**19, 2**20, rng.randint(-100, 400), rng.randint(0, 10**6), rng.randint(0, 2**39)])
        take = 0 if rng.random() < 0.2 else need
        requests.append((no, 1 if rng.random() < 0.33 else rng.randint(2, 8), need, take))
    table = spark.createDataFrame(requests, "no long, department_id long, need long, take long").repartition(5)
    rooms = spark.createDataFrame(list(room.items()), "department_id long, room long")
    got = sorted(r.no for r in guards.refused_by_budget(table, rooms).collect())
    assert got == brute_budget(requests, room)
    assert guards.refused_by_budget(table.limit(0), rooms).count() == 0


def test_budget_takes_rounds_of_digits_not_of_rows(spark, monkeypatch):
    """4,000 requests of one department in which nearly every second is refused."""
    written = []
    original = guards.write_and_read
    monkeypatch.setattr(guards, "AT_ONCE", 100)
    monkeypatch.setattr(guards, "write_and_read", lambda df, label: written.append(label) or original(df, label))
    requests = [(i, 1, 10 if i % 2 else 10**6 + i, 10 if i % 2 else 10**6 + i) for i in range(4000)]
    table = spark.createDataFrame(requests, "no long, department_id long, need long, take long")
    got = sorted(r.no for r in guards.refused_by_budget(table, spark.createDataFrame([(1, 10**6 + 9)], "department_id long, room long")).collect())
    assert got == brute_budget(requests, {1: 10**6 + 9}) and written.count("judged") < 12


def brute_loops(edges, changes):
    above, refused = dict(edges), []
    for who, manager in changes:
        at, steps = manager, 0
        while at is not None and at != who and steps <= len(above):
            at, steps = above.get(at), steps + 1
        if at == who:
            refused.append(who)
        else:
            above[who] = manager
    return sorted(refused)


@pytest.mark.parametrize("seed,block", [(1, 16384), (2, 9)])
def test_loops_in_order(spark, monkeypatch, seed, block):
    monkeypatch.setattr(guards, "LINES_AT_ONCE", block)
    rng = random.Random(seed)
    edges = {i: (rng.randint(max(1, i - 12), i - 1) if i > 3 else None) for i in range(1, 121)}
    who = rng.sample(sorted(edges), 60)
    changes = sorted((i, rng.choice([None, i, *rng.sample(range(1, 121), 6)])) for i in who)
    got = guards.refused_loops(
        spark.createDataFrame(list(edges.items()), "employee_id long, manager_id long"),
        spark.createDataFrame([(i, i, m) for i, m in changes], "employee_id long, turn long, manager_id long").repartition(4),
    )
    assert sorted(r.employee_id for r in got.collect()) == brute_loops(edges, changes)


def test_a_chain_of_a_thousand_and_swaps(spark):
    edges = [(i, i - 1 if i > 1 else None) for i in range(1, 1001)]
    changes = [(1, 1, 1000), (2, 2, None), (3, 3, 1000), (1000, 1000, 2)]
    got = guards.refused_loops(
        spark.createDataFrame(edges, "employee_id long, manager_id long"),
        spark.createDataFrame(changes, "employee_id long, turn long, manager_id long"),
    )
    assert sorted(r.employee_id for r in got.collect()) == [1, 3]


def test_many_changes_do_not_rewrite_all_lines_or_broadcast(spark, monkeypatch):
    """100 employees, 15 changes, 9 at a time: the lines handed on are those of the changes."""
    written, plans, original = {}, [], guards.write_and_read

    def watched(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        done = original(df, label)
        written.setdefault(label, []).append(done.count())
        return done

    monkeypatch.setattr(guards, "LINES_AT_ONCE", 9)
    monkeypatch.setattr(guards, "write_and_read", watched)
    edges = {i: (i // 2 or None) for i in range(1, 101)}
    changes = [(i, 2 * i if i % 3 else i + 1) for i in range(1, 31, 2)]
    got = guards.refused_loops(
        spark.createDataFrame(list(edges.items()), "employee_id long, manager_id long"),
        spark.createDataFrame([(i, i, m) for i, m in changes], "employee_id long, turn long, manager_id long"),
    )
    assert sorted(r.employee_id for r in got.collect()) == brute_loops(edges, changes)
    asks = spark.createDataFrame([(i, f"e{i + 1}") for i in range(1, 5)], "employee_id long, email string")
    owners = spark.createDataFrame([(i, f"e{i}") for i in range(1, 6)], "employee_id long, email string")
    assert guards.refused_addresses(asks, owners, asks.limit(0).select("employee_id")).distinct().count() == 4
    assert max(written["lines"]) <= len(changes) and not any("Broadcast" in plan for plan in plans)


def brute_addresses(owners, wishes, kept):
    """Grant every wish, then take back what clashes until nothing does."""
    kept = set(kept)
    while True:
        now = {i: wishes[i] if i in wishes and i not in kept else e for i, e in owners.items()}
        keeping = {now[i]: i for i in now if i not in wishes or i in kept}
        clash = {i for i in wishes if i not in kept and keeping.get(wishes[i], i) != i}
        if not clash:
            return sorted(kept)
        kept |= clash


def test_addresses_along_chains_and_rings(spark):
    rng = random.Random(4)
    owners = {i: f"e{i}" for i in range(1, 201)}
    targets = rng.sample([f"e{i}" for i in range(1, 260)], 150)
    wishes = dict(zip(rng.sample(sorted(owners), 150), targets, strict=True))
    wishes = {i: e for i, e in wishes.items() if e != f"e{i}"}
    kept = rng.sample(sorted(wishes), 5)
    people = lambda rows: spark.createDataFrame(rows, "employee_id long, email string")
    got = guards.refused_addresses(
        people(list(wishes.items())), people(list(owners.items())), spark.createDataFrame([(i,) for i in kept], "employee_id long")
    )
    assert sorted({r.employee_id for r in got.collect()} | set(kept)) == brute_addresses(owners, wishes, kept)
    chain = {i: f"e{i + 1}" for i in range(1, 200)}  # the last owner keeps, so all fail
    got = guards.refused_addresses(people(list(chain.items())), people(list(owners.items())), spark.createDataFrame([], "employee_id long"))
    assert got.distinct().count() == 199


# --- the write paths ---------------------------------------------------------------


@pytest.fixture
def company(make):
    staff = [
        {"employee_id": i, "email": f"e{i}@company.com", "salary": Decimal(100), "department_id": 1, "position_id": 1,
         "manager_id": None if i == 1 else i - 1}
        for i in range(1, 21)
    ]
    return (
        make("employees", *staff),
        make("departments", {"department_id": 1, "budget": Decimal(4000)}, {"department_id": 2, "budget": Decimal(1000)}),
        make("positions", {"position_id": 1}),
    )


def patch(spark, *rows):
    """(employee_id, {column: value}) as patches."""
    columns = "email string, salary decimal(12,2), department_id long, manager_id long"
    names = [c.split()[0] for c in columns.split(", ")]
    data = [(i, 1, list(values), *[values.get(n) for n in names]) for i, values in rows]
    return spark.createDataFrame(data, f"employee_id long, patch_no int, fields array<string>, {columns}")


def outcome(spark, company, *rows):
    staff, departments, positions = company
    done = apply_checked_updates(staff, patch(spark, *rows), departments, positions, date(2024, 6, 30))
    return {r.employee_id: r for r in done.employees.collect()}, {r.employee_id: r.broken for r in done.refused.collect()}, done


def test_a_refused_patch_keeps_its_address(spark, company):
    now, refused, _ = outcome(
        spark, company,
        (10, {"email": "new@company.com", "salary": Decimal(-1)}),
        (11, {"email": "e10@company.com"}),
        (12, {"email": "e11@company.com"}),
        (13, {"email": "e14@company.com"}),
        (14, {"email": "e13@company.com"}),
    )
    assert refused == {10: ["check salary_positive"], 11: ["unique email"], 12: ["unique email"]}
    assert now[13].email == "e14@company.com" and now[14].email == "e13@company.com"
    assert len({r.email for r in now.values()}) == len(now)


def test_patches_build_no_loop(spark, company):
    _, refused, done = outcome(
        spark, company, (12, {"manager_id": 13}), (13, {"manager_id": 12}), (14, {"manager_id": 14}), (15, {"manager_id": 1}),
        (2, {"manager_id": 15}),
    )
    assert refused == {i: ["reporting loop"] for i in (2, 12, 14)}
    assert hierarchy_violations(done.employees).isEmpty()


def test_a_loop_made_by_two_patches(spark, company, make):
    staff = [{"employee_id": i, "email": f"e{i}@company.com", "manager_id": 1 if i > 1 else None} for i in range(1, 5)]
    company = (make("employees", *staff), *company[1:])
    _, refused, done = outcome(spark, company, (2, {"manager_id": 3}), (3, {"manager_id": 2}), (4, {"manager_id": 3}))
    assert refused == {3: ["reporting loop"]} and hierarchy_violations(done.employees).isEmpty()


def test_patches_stay_within_the_budget(spark, company):
    # 20 x 100 of 2,800 in department 1; 700 in department 2.
    now, refused, _ = outcome(
        spark, company,
        (3, {"salary": Decimal(99_999)}), (4, {"salary": Decimal(600)}), (5, {"salary": Decimal(500)}),
        (6, {"salary": Decimal(400)}), (7, {"department_id": 2, "salary": Decimal(700)}), (8, {"department_id": 2}),
        (15, {"salary": Decimal(99_999_999)}),
    )
    assert {i: r for i, r in refused.items()} == {i: ["payroll over budget"] for i in (3, 5, 8, 15)}
    assert now[4].salary == 600 and now[6].salary == 400 and now[7].department_id == 2


def brute_import(rows, staff, departments):
    """Row by row: address, then budget."""
    emails, fund, out = {e for e, _, _ in staff}, {}, []
    for _, place, pay in staff:
        fund[place] = fund.get(place, 0) + pay
    for row_no, email, place, pay in rows:
        if email in emails:
            out.append((row_no, "email"))
        elif departments[place] is not None and fund.get(place, 0) + pay > departments[place] * Decimal("0.7"):
            out.append((row_no, "budget"))
        else:
            emails.add(email)
            fund[place] = fund.get(place, 0) + pay
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_import_row_by_row(spark, make, seed):
    rng = random.Random(seed)
    budgets = {1: Decimal(3000), 2: Decimal("1500.55"), 3: Decimal(400), 4: None}
    departments = make("departments", *[{"department_id": d, "budget": b, "department_name": f"d{d}"} for d, b in budgets.items()])
    staff = [(f"s{i}@company.com", 1 + i % 4, Decimal(50)) for i in range(8)]
    people = make("employees", *[{"employee_id": i, "email": e, "department_id": d, "salary": p} for i, (e, d, p) in enumerate(staff)])
    rows = [
        (n, rng.choice([f"new{rng.randint(0, 60)}@company.com", f"s{rng.randint(0, 9)}@company.com"]),
         1 if rng.random() < 0.4 else rng.randint(1, 4), Decimal(rng.choice([10, 25.5, 90, 400, 999])))
        for n in range(1, 181)
    ]
    lines = spark.createDataFrame(
        [(n, "Имя", "Фамилия", e, "2020-01-01", str(p), str(d), "1", None) for n, e, d, p in rows],
        "row_no long, " + ", ".join(f"{c} string" for c in intake.CSV_COLUMNS),
    )
    done = intake.import_employees(lines.repartition(4), people, departments, make("positions", {"position_id": 1}), date(2024, 6, 30))
    got = sorted((r.row, "budget" if labels.OVER_BUDGET in r.error else "email") for r in done.rejected.collect())
    assert got == brute_import(rows, staff, budgets)
    requests = lines.select(
        F.col("row_no").alias("request_no"), "email", F.col("department_id").cast("long").alias("department_id"),
        F.col("salary").cast("decimal(12,2)").alias("salary"), F.lit(None).cast("long").alias("manager_id"),
    )
    judged = intake.validate_new_employees(requests, people, departments).filter("error IS NOT NULL").collect()
    assert sorted((r.request_no, "budget" if r.error == labels.OVER_BUDGET else "email") for r in judged) == got
