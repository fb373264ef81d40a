import random
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from rosterlake.functions.expressions import asc, desc
from rosterlake.operators import change_checks, changes, listing, pages, quality, snapshots

AS_OF = date(2023, 2, 28)


def people(spark, rows):
    return spark.createDataFrame(rows, "employee_id long, a string, b string, salary decimal(12,2)")


def test_changed_rows_equal_a_comparison_of_all(spark):
    rng = random.Random(3)
    old = {i: (rng.choice(["x", None]), rng.choice(["y", None]), Decimal(rng.randint(0, 3))) for i in range(3000)}
    new = dict(old)
    for i in rng.sample(range(3000), 40):
        a, b, salary = new[i]
        new[i] = (b, a, salary)  # the same values in other columns, some the same as before
    for i in rng.sample(range(3000), 10):
        new.pop(i)
    new |= {9000 + i: ("n", None, None) for i in range(5)}
    before = people(spark, [(i, *v) for i, v in old.items()])
    after = people(spark, [(i, *v) for i, v in new.items()])
    gone, come = snapshots.changed_rows(before, after, "employee_id")
    assert {tuple(r) for r in gone.collect()} == {(i, *v) for i, v in old.items() if new.get(i) != v}
    assert {tuple(r) for r in come.collect()} == {(i, *v) for i, v in new.items() if old.get(i) != v}
    nothing = snapshots.changed_rows(before, before, "employee_id")
    assert [side.count() for side in nothing] == [0, 0]
    gone, come = snapshots.changed_rows(before.limit(0), after, "employee_id")
    assert (gone.count(), come.count()) == (0, len(new))


def test_a_repeated_row_is_a_difference(spark):
    row = (1, "x", "y", Decimal(1))
    once, thrice = people(spark, [row]), people(spark, [row] * 3)
    old, new = snapshots.differing(once, thrice, "employee_id", ["a", "b", "salary"])
    assert (old.count(), new.count()) == (1, 3)


def test_few_changes_give_the_same_rows_from_few(spark, make):
    base = make("employees", *[{"employee_id": i, "salary": Decimal(100 + i)} for i in range(20_000)])
    after = base.withColumn(
        "salary", F.expr("cast(CASE WHEN employee_id < 20 THEN salary + 1 ELSE salary END as decimal(12,2))")
    )
    at = datetime(2023, 2, 28)
    plain, few = (changes.audit_diff(base, after, at, few_changes=how) for how in (False, True))
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in plain.collect()}
    left, right = snapshots.differing(base, after, "employee_id", ["salary"])
    # 20 changed rows lie in at most 20 pieces of some hundredths of a row each.
    assert left.count() <= 40 and right.count() <= 40
    touched = [changes.touch(base, after, F.lit(at), few_changes=how) for how in (False, True)]
    assert touched[0].exceptAll(touched[1]).count() == touched[1].exceptAll(touched[0]).count() == 0


def test_pages_follow_one_another(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 2, 2]), i, f"t{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "place long, range long, row string")
    keys = [desc("place"), asc("range")]
    wanted = [tuple(r) for r in df.orderBy(*keys).collect()]
    folder = str(tmp_path / "ranges")
    pages.save_ranges(df, folder, *keys, ranges=7)
    for skip, limit in [(0, 10), (123, 100), (495, 100), (500, 10), (0, None), (250, None), (60, 0)]:
        read = [tuple(r) for r in pages.read_page(spark, folder, df.schema, skip, limit).collect()]
        assert read == wanted[skip:][:limit], (skip, limit)
    plan = pages.read_page(spark, folder, df.schema, 250, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "GreaterThanOrEqual(place" in plan
    assert pages.deep_page(df.limit(0), 0, 10, *keys).collect() == []
    monkeypatch.setattr(listing, "DEEP", 100)
    assert [tuple(r) for r in listing.page(df, 120, 9, *keys).collect()] == wanted[120:129]
    pager = [("place", True), ("range", False)]
    for at in (0, 99, 250, 498, 499):
        read = pages.page_after(df, pager, wanted[at][:2], 7).collect()
        assert [tuple(r) for r in read] == wanted[at + 1 :][:7]
    back = [("place", False), ("range", True)]
    up = [tuple(r) for r in df.orderBy(asc("place"), desc("range")).collect()]
    for at in (0, 250, 450, 499):
        read = pages.page_after(df, back, up[at][:2], 7).collect()
        assert [tuple(r) for r in read] == up[at + 1 :][:7]


def test_change_report_is_the_difference_of_two_reports(spark, make):
    rng = random.Random(11)

    def rows(n):
        return {
            i: {
                "employee_id": i,
                "email": rng.choice(["bad", "a@x.org", f"{i}@x.org", None]),
                "phone": rng.choice([None, "1", "2", f"{i}"]),
                "salary": Decimal(rng.choice([-1, 5])),
                "department_id": rng.choice([1, 2, 3, None]),
                "manager_id": rng.choice([None, *range(n + 5)]),
            }
            for i in range(n)
        }

    old = rows(60)
    new = {**old, **{i: r for i, r in rows(60).items() if i % 4 == 0}}
    for i in (3, 7, 21):
        new.pop(i)
    new[100] = {**new[1], "employee_id": 100}

    def tables(staff, departments):
        return {
            "employees": make("employees", *staff),
            "departments": make("departments", *[{"department_id": d} for d in departments]),
            "positions": make("positions", {"position_id": 1}),
            "vacations": make("vacations", *[{"vacation_id": i, "employee_id": i, "approved_by": 3} for i in range(30)]),
        }

    # A repeated primary key and a parent that goes once of twice.
    before = tables([*old.values(), old[5]], [1, 2, 2, 3])
    after = tables([*new.values(), new[5], new[9]], [1, 2, 4])
    gone = before["departments"].exceptAll(after["departments"]), after["departments"].exceptAll(before["departments"])
    moved = {
        "employees": (
            before["employees"].exceptAll(after["employees"]),
            after["employees"].exceptAll(before["employees"]),
        ),
        "departments": gone,
    }

    def counted(report, column):
        return {(r.table_name, r.constraint_name): r[column] for r in report.collect()}

    was = counted(quality.constraint_report(before, AS_OF), "violations")
    now = counted(quality.constraint_report(after, AS_OF), "violations")
    judged = counted(change_checks.change_report(after, moved, AS_OF), "change")
    assert {k: v for k, v in judged.items() if v} == {k: now[k] - was[k] for k in now if now[k] != was[k]}
    assert len([v for v in judged.values() if v]) > 8
    nothing = {"employees": (before["employees"].limit(0), before["employees"].limit(0))}
    assert set(counted(change_checks.change_report(before, nothing, AS_OF), "change").values()) == {0}
