from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from rosterlake import labels
from rosterlake.functions import payroll
from rosterlake.operators import changes, raises, staffing

AS_OF = date(2023, 2, 28)


def test_audit_keeps_nulls_and_skips_unchanged_rows(make):
    before = make("employees", {"employee_id": 1}, {"employee_id": 2}, {"employee_id": 3})
    after = make(
        "employees",
        {"employee_id": 1},
        {"employee_id": 2, "salary": Decimal("120.50")},
        {"employee_id": 4},
    )
    rows = {
        r.record_id: r
        for r in changes.audit_diff(before, after, datetime(2023, 1, 1), changed_by=5).collect()
    }
    assert {k: r.operation_type for k, r in rows.items()} == {
        2: "UPDATE",
        3: "DELETE",
        4: "INSERT",
    }
    assert '"salary":120.50' in rows[2].new_values
    assert '"manager_id":null' in rows[2].old_values
    assert rows[3].new_values is None
    assert rows[4].old_values is None
    assert rows[4].changed_by == 5


def test_salary_changes_split(make):
    before = make("employees", {"employee_id": 1}, {"employee_id": 2}, {"employee_id": 3})
    after = make(
        "employees",
        {"employee_id": 1, "salary": Decimal(110)},
        {"employee_id": 2, "salary": Decimal(90)},
        {"employee_id": 3},
    )
    kept, rejected = changes.salary_changes(before, after, AS_OF)
    assert [(r.employee_id, r.change_reason) for r in kept.collect()] == [(1, "salary_adjustment")]
    assert [r.employee_id for r in rejected.collect()] == [2]


def test_touch_leaves_new_and_unchanged_rows(make):
    old = datetime(2020, 1, 1)
    before = make(
        "employees", {"employee_id": 1, "updated_at": old}, {"employee_id": 2, "updated_at": old}
    )
    after = make(
        "employees",
        {"employee_id": 1, "updated_at": old},
        {"employee_id": 2, "updated_at": old, "phone": "1"},
        {"employee_id": 3, "updated_at": old},
    )
    now = datetime(2023, 1, 1)
    touched = changes.touch(before, after, F.lit(now).cast("timestamp_ntz"))
    assert {r.employee_id: r.updated_at for r in touched.collect()} == {1: old, 2: now, 3: old}
    assert touched.columns[-1] == "updated_at"


def test_last_move_wins(make):
    positions = make(
        "positions", {"position_id": 1}, {"position_id": 2, "position_level": "director"}
    )
    before = make("employees", {"employee_id": 1}, {"employee_id": 2}, {"employee_id": 4, "position_id": 2})
    after = make(
        "employees",
        {"employee_id": 1, "position_id": 2},
        {"employee_id": 2, "position_id": 2},
        {"employee_id": 3, "position_id": 2, "department_id": 2},
        {"employee_id": 4, "position_id": 2},
    ).withColumn(
        "changed_on",
        F.expr("date_sub(DATE'2023-01-01', cast(employee_id as int))"),
    )
    departments = make(
        "departments",
        {"department_id": 1, "manager_id": 9},
        {"department_id": 2},
        {"department_id": 3, "manager_id": 7},
    )
    heads = changes.reassign_department_heads(before, after, positions, departments)
    assert {r.department_id: r.manager_id for r in heads.collect()} == {1: 1, 2: 3, 3: 7}


def test_project_status_and_vacation_length(make):
    projects = make(
        "projects",
        {"project_id": 1, "end_date": date(2023, 2, 27), "status": "cancelled"},
        {"project_id": 2, "status": "planning"},
        {"project_id": 3, "status": "planning", "start_date": date(2024, 1, 1)},
        {"project_id": 4, "status": "on_hold"},
    )
    status = {r.project_id: r.status for r in changes.project_status(projects, AS_OF).collect()}
    assert status == {1: "completed", 2: "active", 3: "planning", 4: "on_hold"}
    vacations = make(
        "vacations",
        {"vacation_id": 1, "employee_id": 1, "start_date": date(2023, 1, 1), "end_date": date(2023, 3, 1)},
        {"vacation_id": 2, "employee_id": 1, "start_date": date(2023, 1, 1), "end_date": date(2023, 3, 2)},
    )
    kept, rejected = changes.vacation_days_check(vacations)
    assert [(r.vacation_id, r.days_count) for r in kept.collect()] == [(1, 60)]
    assert [(r.vacation_id, r.days_count) for r in rejected.collect()] == [(2, 61)]


def test_budget_guard_counts_inactive_rows_themselves(make):
    departments = make("departments", {"department_id": 1, "budget": Decimal(1000)})
    employees = make(
        "employees",
        {"employee_id": 1, "salary": Decimal(700)},
        {"employee_id": 2, "salary": Decimal(1), "is_active": False},
    )
    rows = changes.budget_violations(employees, departments).collect()
    assert [(r.employee_id, r.fund) for r in rows] == [(2, Decimal(701))]


def test_patches_in_order_and_to_null(spark, make):
    employees = make("employees", {"employee_id": 1, "phone": "1"}, {"employee_id": 2, "phone": "2"})
    patches = spark.createDataFrame(
        [
            (1, 1, "9", Decimal(5), ["phone", "salary"]),
            (1, 2, None, None, ["phone"]),
            (3, 1, "7", None, ["phone"]),
        ],
        "employee_id long, patch_no int, phone string, salary decimal(12,2), fields array<string>",
    )
    updated, unknown = changes.apply_updates(employees, patches)
    assert {r.employee_id: (r.phone, r.salary) for r in updated.collect()} == {
        1: (None, Decimal(5)),
        2: ("2", Decimal(100)),
    }
    assert updated.columns == employees.columns
    assert [r.employee_id for r in unknown.collect()] == [3]


def test_delete_cascades_clears_and_blocks(spark, make):
    tables = {
        "employees": make(
            "employees",
            {"employee_id": 1},
            {"employee_id": 2, "manager_id": 1},
            {"employee_id": 3, "manager_id": 2},
            {"employee_id": 4},
        ),
        "projects": make("projects", {"project_id": 1, "project_manager_id": 4}),
        "vacations": make(
            "vacations",
            {"vacation_id": 1, "employee_id": 1},
            {"vacation_id": 2, "employee_id": 3, "approved_by": 1},
        ),
        "audit_log": make("audit_log", {"log_id": 1, "record_id": 1, "changed_by": 1}),
    }
    ids = spark.createDataFrame([(1,), (4,)], "employee_id long")
    left, blocked = changes.delete_employees(ids, tables)
    assert [(r.employee_id, r.held_by) for r in blocked.collect()] == [
        (4, "projects.project_manager_id")
    ]
    assert {r.employee_id: r.manager_id for r in left["employees"].collect()} == {
        2: None,
        3: 2,
        4: None,
    }
    assert [(r.vacation_id, r.approved_by) for r in left["vacations"].collect()] == [(2, None)]
    assert left["audit_log"].collect()[0].changed_by is None
    assert left["audit_log"].columns == tables["audit_log"].columns


def test_managers_are_filled_in_two_steps(make):
    departments = make(
        "departments",
        {"department_id": 1, "manager_id": 1},
        {"department_id": 2, "manager_id": 2},
        {"department_id": 3},
    )
    employees = make(
        "employees",
        {"employee_id": 1},
        {"employee_id": 2, "department_id": 2},
        {"employee_id": 3, "department_id": 2},
        {"employee_id": 4, "department_id": 3},
        {"employee_id": 5, "department_id": 1, "manager_id": 3},
    )
    filled = staffing.fill_managers(employees, departments)
    assert {r.employee_id: r.manager_id for r in filled.collect()} == {
        1: None,
        2: 1,
        3: 2,
        4: None,
        5: 3,
    }


def test_head_is_the_best_paid(make):
    departments = make("departments", {"department_id": 1}, {"department_id": 2, "manager_id": 9})
    employees = make(
        "employees",
        {"employee_id": 3, "salary": Decimal(500)},
        {"employee_id": 2, "salary": Decimal(500)},
        {"employee_id": 1, "salary": Decimal(10)},
    )
    heads = staffing.fill_department_heads(departments, employees)
    assert {r.department_id: r.manager_id for r in heads.collect()} == {1: 2, 2: 9}


def test_first_position_rule_wins(make):
    departments = make(
        "departments",
        {"department_id": 1, "department_name": "Отдел ИТ"},
        {"department_id": 2, "department_name": "Бухгалтерия"},
    )
    employees = make(
        "employees",
        {"employee_id": 1, "salary": Decimal(260_000), "position_id": None},
        {"employee_id": 2, "salary": Decimal(210_000), "position_id": None},
        {"employee_id": 3, "salary": Decimal(90_000), "position_id": None},
        {"employee_id": 4, "salary": Decimal(90_000), "position_id": None, "department_id": 2},
        {"employee_id": 5, "salary": Decimal(10), "position_id": None},
        {"employee_id": 6, "salary": Decimal(260_000), "position_id": 5},
    )
    chosen = staffing.assign_positions(employees, departments)
    assert {r.employee_id: r.position_id for r in chosen.collect()} == {
        1: 1,
        2: 2,
        3: 8,
        4: 14,
        5: 18,
        6: 5,
    }


def test_everyone_draws_from_the_own_department(make):
    projects = make(
        "projects",
        *[{"project_id": i, "department_id": 1 if i < 6 else 2} for i in range(1, 8)],
    )
    employees = make(
        "employees",
        *[{"employee_id": i, "department_id": i % 3 + 1} for i in range(1, 13)],
    )
    none = make("employee_projects")
    drawn = staffing.assign_projects(employees, projects, none, F.lit(50), F.col("start_date"), per_employee=2)
    rows = [(r.employee_id, r.project_id) for r in drawn.collect()]
    assert len(rows) == len(set(rows)) == 16
    for employee, project in rows:
        assert (employee % 3 + 1) == (1 if project < 6 else 2)
    kept = make("employee_projects", *[{"employee_id": e, "project_id": p} for e, p in rows[:5]])
    again = staffing.assign_projects(employees, projects, kept, F.lit(50), F.col("start_date"), per_employee=2)
    assert {(r.employee_id, r.project_id) for r in again.collect()} == set(rows[5:])


def test_slots_number_every_group_without_gaps(spark):
    rows = [(i % 3, i) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, k long")
    slots = staffing.numbered_in_group(df.repartition(7), "g", "k").collect()
    for group in range(3):
        of_group = sorted((r for r in slots if r.g == group), key=lambda r: r.k)
        assert [r.slot for r in of_group] == list(range(len(of_group)))
        assert {r.group_size for r in of_group} == {len(of_group)}


def test_skills_follow_salary(make):
    departments = make("departments", {"department_id": 1, "department_name": "ИТ"}, {"department_id": 2})
    employees = make(
        "employees",
        {"employee_id": 1, "salary": Decimal(150_000)},
        {"employee_id": 2, "salary": Decimal(100_000)},
        {"employee_id": 3, "salary": Decimal(69_999)},
        {"employee_id": 4, "department_id": 2},
    )
    skills = make("skills", {"skill_id": 1}, {"skill_id": 2, "category": "business"})
    held = make("employee_skills", {"employee_id": 3, "skill_id": 1})
    rows = staffing.assign_skills(employees, departments, skills, held, ["databases"], ["ИТ"])
    assert sorted(tuple(r) for r in rows.collect()) == [
        (1, 1, "expert", True),
        (2, 1, "advanced", True),
    ]


def test_role_of_the_project_manager(make):
    drawn = staffing.assign_projects(
        make("employees", {"employee_id": 1}, {"employee_id": 2, "salary": Decimal(150_000)}),
        make("projects", {"project_id": 1}),
        make("employee_projects"),
        F.lit(100),
        F.col("start_date"),
    )
    assert {r.employee_id: r.role_in_project for r in drawn.collect()} == {
        1: labels.ROLE_HEAD,
        2: labels.ROLE_LEADING,
    }


def test_raise_is_all_or_nothing(make):
    employees = make(
        "employees",
        {"employee_id": 1, "salary": Decimal(100), "department_id": 1},
        {"employee_id": 2, "salary": Decimal(200), "department_id": 1},
        {"employee_id": 3, "salary": Decimal(300), "department_id": 1, "is_active": False},
        {"employee_id": 4, "salary": Decimal(400), "department_id": 2},
    )
    at = datetime(2024, 1, 1)
    for budget, paid in ((1000, {1: 110, 2: 220, 3: 300, 4: 400}), (400, {1: 100, 2: 200, 3: 300, 4: 400})):
        departments = make("departments", {"department_id": 1, "budget": Decimal(budget)}, {"department_id": 2})
        job = raises.raise_department(employees, departments, 1, Decimal(10), at)
        assert {r.employee_id: int(r.salary) for r in job.employees.collect()} == paid
        changed = {i for i in paid if paid[i] != 100 * i}
        assert {r.employee_id for r in job.history.collect()} == changed
        assert {r.record_id for r in job.audit.collect()} == changed
        assert {r.employee_id for r in job.refused.collect()} == (set() if changed else {1, 2})
        assert [r.department_id for r in job.stats.collect()] == ([1] if changed else [])
        assert {r.employee_id for r in job.employees.collect() if r.updated_at} == changed
        assert all(r.change_reason == payroll.raise_reason(1, Decimal(10)) for r in job.history.collect())
