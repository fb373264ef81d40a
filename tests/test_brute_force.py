"""Operators against plain Python over random small inputs."""

import random
from datetime import date
from decimal import Decimal

import pytest

from rosterlake.operators import hierarchy, reports
from rosterlake.sources import intake

AS_OF = date(2023, 2, 28)


def line_of(manager, start):
    """Superiors of ``start`` in order, and whether the line runs into a loop."""
    seen, line, at = {start}, [], manager.get(start)
    while at is not None and at in manager:
        if at in seen:
            return line, True
        seen.add(at)
        line.append(at)
        at = manager[at]
    return line, False


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_reporting_lines(make, seed):
    rng = random.Random(seed)
    people = range(1, 61)
    manager = {}
    for person in people:
        roll = rng.random()
        if roll < 0.06:
            manager[person] = None
        elif roll < 0.09:
            manager[person] = 999
        elif roll < 0.15:
            manager[person] = rng.choice(people)
        else:
            manager[person] = rng.randint(1, max(1, person - 1))
    active = {p: rng.random() < 0.9 for p in people}
    employees = make(
        "employees",
        *[
            {
                "employee_id": p,
                "manager_id": manager[p],
                "first_name": "E",
                "last_name": str(p),
                "is_active": active[p],
            }
            for p in people
        ],
    )
    loops = {p for p in people if _returns(manager, p)}
    found = {(r.employee_id, r.violation) for r in hierarchy.hierarchy_violations(employees).collect()}
    assert found == {(p, "self_manager" if manager[p] == p else "cycle") for p in loops}

    tree = hierarchy.employee_hierarchy(
        employees, make("departments", {"department_id": 1, "budget": None}), make("positions", {"position_id": 1})
    ).collect()
    expected = {}
    for person in people:
        line, looping = line_of(manager, person)
        whole = [person, *line]
        if looping or manager[whole[-1]] is not None or not all(active[p] for p in whole):
            continue
        expected[person] = (len(whole), " → ".join(f"E {p}" for p in reversed(whole)))
    assert {r.employee_id: (r.level, r.reporting_path) for r in tree} == expected

    boss = rng.choice(list(people))
    below = {}
    for person in people:
        line, _ = line_of(manager, person)
        if person != boss and boss in line:
            below[person] = line.index(boss) + 1
    assert {r.employee_id: r.level for r in hierarchy.subordinates(employees, boss).collect()} == below


def _returns(manager, start):
    at = manager.get(start)
    for _ in range(len(manager) + 1):
        if at == start:
            return True
        if at is None or at not in manager:
            return False
        at = manager[at]
    return False


@pytest.mark.parametrize("seed", [1, 2])
def test_random_imports_row_by_row(spark, make, tmp_path, seed):
    rng = random.Random(seed)
    emails = [f"u{i}@x.org" for i in range(12)] + ["", "nowhere", "old@x.org"]
    rows = [
        (
            rng.choice(emails),
            rng.choice(["A", "A", "A", ""]),
            rng.choice(["5", "7", "", "-3", "much"]),
            rng.choice(["1", "1", "1", "8"]),
        )
        for _ in range(120)
    ]
    text = "email,first_name,last_name,salary,department_id,position_id\n" + "".join(
        f"{e},{n},B,{s},{d},1\n" for e, n, s, d in rows
    )
    (tmp_path / "in.csv").write_text(text)
    result = intake.import_employees(
        intake.read_numbered_csv(spark, str(tmp_path)),
        make("employees", {"employee_id": 1, "email": "old@x.org"}),
        make("departments", {"department_id": 1, "budget": None}),
        make("positions", {"position_id": 1}),
        AS_OF,
    )
    taken, accepted = {"old@x.org"}, {}
    for number, (email, name, salary, department) in enumerate(rows, 1):
        sound = email and name and "@" in email and salary not in ("-3", "much")
        if sound and department == "1" and email not in taken:
            taken.add(email)
            accepted[number] = Decimal(salary or 0)
    assert {r.row_no: r.salary for r in result.accepted.collect()} == accepted
    assert result.rejected.count() == len(rows) - len(accepted)


def test_random_skills_and_teams(make):
    rng = random.Random(5)
    staff = {
        e: (Decimal(rng.randint(100, 999)), rng.randint(1, 4), rng.random() < 0.8)
        for e in range(1, 31)
    }
    levels = ["beginner", "intermediate", "advanced", "expert"]
    held = {
        (rng.randint(1, 30), rng.randint(1, 5)): (rng.choice(levels), rng.random() < 0.5)
        for _ in range(90)
    }
    rows = reports.skill_analytics(
        make("skills", *[{"skill_id": s, "skill_name": f"S{s}"} for s in range(1, 6)]),
        make(
            "employee_skills",
            *[
                {"employee_id": e, "skill_id": s, "proficiency_level": lv, "certified": c}
                for (e, s), (lv, c) in held.items()
            ],
        ),
        make(
            "employees",
            *[
                {"employee_id": e, "salary": pay, "department_id": d, "is_active": a}
                for e, (pay, d, a) in staff.items()
            ],
        ),
        make(
            "departments",
            *[{"department_id": d, "department_name": f"D{d}"} for d in range(1, 5)],
        ),
    ).collect()
    for row in rows:
        mine = {e: v for (e, s), v in held.items() if s == row.skill_id}
        assert row.employees_with_skill == len(mine)
        assert row.certified_employees == sum(c for _, c in mine.values())
        experts = [staff[e][0] for e, (lv, _) in mine.items() if lv == "expert" and staff[e][2]]
        if experts:
            assert abs(row.avg_salary_expert - sum(experts) / len(experts)) <= Decimal("0.005")
        else:
            assert row.avg_salary_expert is None
        places = {}
        for e in mine:
            if staff[e][2]:
                name = f"D{staff[e][1]}"
                places[name] = places.get(name, 0) + 1
        assert row.top_departments == sorted(places, key=lambda n: (-places[n], n))[:3]
