from datetime import date
from decimal import Decimal

import pytest

from rosterlake import labels
from rosterlake.functions import payroll
from rosterlake.functions.expressions import completed_years
from rosterlake.operators import listing, reports

AS_OF = date(2023, 2, 28)


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_completed_years_on_leap_day(spark):
    df = spark.createDataFrame(
        [(date(2020, 2, 29),), (date(2020, 2, 28),), (date(2023, 2, 28),)], "d date"
    )
    years = [r[0] for r in df.select(completed_years(df.d, AS_OF)).collect()]
    assert years == [2, 3, 0]


def test_details_with_missing_places(make):
    employees = make(
        "employees",
        {"employee_id": 1, "salary": Decimal(50), "is_active": None},
        {"employee_id": 2, "salary": Decimal(150), "manager_id": 1},
        {"employee_id": 3, "salary": Decimal(150), "position_id": 9, "department_id": 9},
    )
    rows = by(
        reports.employee_details(
            employees,
            make("departments", {"department_id": 1}),
            make("positions", {"position_id": 1, "base_salary_min": Decimal(60)}),
            AS_OF,
        ),
        "employee_id",
    )
    assert rows[1].salary_benchmark == labels.BELOW_BAND
    assert rows[1].activity_status == labels.NOT_ACTIVE
    assert rows[2].salary_benchmark == labels.ABOVE_BAND
    assert rows[2].manager_email == "a@company.com"
    assert rows[3].salary_benchmark == labels.WITHIN_BAND
    assert rows[3].department_name is None


def test_salary_report_zero_budget_and_empty_department(make):
    departments = make(
        "departments",
        {"department_id": 1, "budget": Decimal(0)},
        {"department_id": 2, "department_name": "Пусто"},
    )
    employees = make(
        "employees", {"employee_id": 1}, {"employee_id": 2, "is_active": None}
    )
    rows = by(
        reports.department_salary_report(
            departments, employees, make("positions", {"position_id": 1})
        ),
        "department_id",
    )
    assert rows[1].salary_to_budget_percentage is None
    assert (rows[1].total_employees, rows[1].active_employees) == (2, 1)
    assert rows[1].inactive_employees == 0
    assert rows[2].total_employees == 0
    assert rows[2].avg_salary == 0
    assert rows[2].salary_to_budget_percentage == 0


def test_payroll_puts_empty_departments_first(make):
    departments = make("departments", {"department_id": 1}, {"department_id": 2})
    employees = make("employees", {"employee_id": 1, "is_active": False})
    rows = reports.department_payroll(departments, employees).collect()
    assert [(r.department_id, r.total_salary) for r in rows] == [(2, None), (1, Decimal(100))]
    assert rows[0].employee_count == 0


def test_project_report_edges(make):
    projects = make(
        "projects",
        {"project_id": 1, "end_date": date(2020, 1, 1)},
        {"project_id": 2, "status": "planning"},
        {"project_id": 3, "end_date": date(2023, 3, 4), "status": "on_hold"},
        {"project_id": 4, "end_date": date(2023, 3, 7)},
    )
    team = make(
        "employee_projects",
        {"employee_id": 1, "project_id": 2, "participation_percentage": 50},
        {
            "employee_id": 1,
            "project_id": 2,
            "participation_percentage": 25,
            "hourly_rate": Decimal(10),
            "end_date": date(2021, 1, 1),
        },
    )
    employees = make("employees", {"employee_id": 1, "salary": Decimal(1200)})
    rows = by(
        reports.project_resource_report(
            projects, team, employees, make("departments", {"department_id": 1}), AS_OF
        ),
        "project_id",
    )
    assert rows[1].progress_percentage == 100
    assert rows[1].project_status_detailed == labels.OVERDUE
    assert rows[2].progress_percentage is None
    assert rows[2].total_team_members == rows[2].current_team_members == 1
    assert rows[2].total_participation_percentage == 75
    assert rows[2].avg_participation_percentage == Decimal("37.5")
    assert rows[2].estimated_monthly_cost == 50 + 400
    assert rows[2].project_status_detailed == "planning"
    assert rows[3].project_status_detailed == labels.URGENT
    assert rows[4].project_status_detailed == labels.IN_PROGRESS
    assert rows[4].estimated_monthly_cost == 0
    order = [
        r.project_id
        for r in reports.project_resource_report(
            projects, team, employees, make("departments", {"department_id": 1}), AS_OF
        ).collect()
    ]
    assert order == [1, 4, 2, 3]


def test_skills_count_inactive_holders_but_not_their_pay(make):
    employees = make(
        "employees",
        {"employee_id": 1, "salary": Decimal(100)},
        {"employee_id": 2, "salary": Decimal(900), "is_active": False},
        {"employee_id": 3, "salary": Decimal(200), "department_id": 2},
    )
    held = make(
        "employee_skills",
        {"employee_id": 1, "skill_id": 1, "certified": True},
        {"employee_id": 2, "skill_id": 1},
        {"employee_id": 3, "skill_id": 1},
    )
    departments = make(
        "departments",
        {"department_id": 1, "department_name": "Б"},
        {"department_id": 2, "department_name": "А"},
    )
    skills = make("skills", {"skill_id": 1}, {"skill_id": 2, "skill_name": "Git"})
    rows = by(reports.skill_analytics(skills, held, employees, departments), "skill_id")
    assert rows[1].employees_with_skill == rows[1].experts == 3
    assert rows[1].certified_employees == 1
    assert rows[1].avg_salary_expert == 150
    assert rows[1].avg_salary_beginner is None
    assert rows[1].top_departments == ["А", "Б"]
    assert rows[2].employees_with_skill == 0
    assert rows[2].top_departments == []


def test_vacation_alerts(make):
    def leave(key, start, end, status):
        return {
            "vacation_id": key,
            "employee_id": 1,
            "start_date": start,
            "end_date": end,
            "days_count": (end - start).days + 1,
            "status": status,
            "approved_by": 1,
        }

    vacations = make(
        "vacations",
        leave(1, date(2023, 1, 1), date(2023, 2, 10), "taken"),
        leave(2, date(2023, 2, 28), date(2023, 3, 6), "approved"),
        leave(3, date(2023, 3, 1), date(2023, 3, 7), "approved"),
        leave(4, date(2023, 3, 1), date(2023, 3, 2), "requested"),
    )
    rows = by(
        reports.vacation_calendar(
            vacations,
            make("employees", {"employee_id": 1}),
            make("departments", {"department_id": 1}),
            make("positions", {"position_id": 1}),
            AS_OF,
        ),
        "vacation_id",
    )
    assert set(rows) == {1, 2, 3}
    assert (rows[1].vacation_timeline, rows[1].vacation_alert) == (
        labels.FINISHED,
        labels.LONG_LEAVE,
    )
    assert (rows[2].vacation_timeline, rows[2].vacation_alert) == (
        labels.CURRENT,
        labels.STARTS_SOON,
    )
    assert (rows[3].vacation_timeline, rows[3].vacation_alert) == (labels.PLANNED, labels.NORMAL)


def test_salary_changes_from_nothing(make):
    history = make(
        "salary_history",
        {"employee_id": 1, "old_salary": Decimal(0), "new_salary": Decimal(10)},
        {"employee_id": 9, "old_salary": Decimal(10), "new_salary": Decimal(15)},
    )
    row = reports.salary_change_analysis(
        history,
        make("employees", {"employee_id": 1}),
        make("departments", {"department_id": 1}),
    ).collect()[0]
    assert row.month_name == "January   2020"
    assert row.employees_with_changes == row.total_changes == 2
    assert row.avg_percentage_increase == 50
    assert row.avg_amount_increase == Decimal("7.5")
    assert row.top_departments == ["Отдел"]


def test_dashboard_over_empty_tables(make):
    row = reports.hr_dashboard(
        make("employees"), make("departments"), make("projects"), make("vacations"), AS_OF
    ).collect()[0]
    assert row.total_active_employees == row.total_departments == 0
    assert row.total_salary_fund is None
    assert row.salary_to_budget_percentage_company is None


def test_search_shows_all_skills_of_a_match(make):
    employees = make("employees", {"employee_id": 1}, {"employee_id": 2}, {"employee_id": 3})
    held = make(
        "employee_skills",
        {"employee_id": 1, "skill_id": 1},
        {"employee_id": 1, "skill_id": 2},
        {"employee_id": 2, "skill_id": 2},
    )
    skills = make("skills", {"skill_id": 1}, {"skill_id": 2, "skill_name": "Git"})
    tables = (
        employees,
        make("departments", {"department_id": 1}),
        make("positions", {"position_id": 1}),
        held,
        skills,
    )
    everyone = by(listing.search_employees(*tables), "employee_id")
    assert everyone[3].skills == []
    found = by(listing.search_employees(*tables, skill_ids=[1]), "employee_id")
    assert {k: r.skills for k, r in found.items()} == {1: ["Git", "SQL"]}
    assert listing.search_employees(*tables, min_salary=101).count() == 0
    assert listing.search_employees(*tables, department_id=2).count() == 0
    assert listing.search_employees(*tables, position_id=1).count() == 3


def test_raise_bounds(make):
    employees = make(
        "employees",
        {"employee_id": 1, "salary": Decimal("33.33")},
        {"employee_id": 2, "is_active": False},
        {"employee_id": 3, "department_id": 2},
    )
    for bad in (Decimal(0), Decimal(-1), Decimal("100.01")):
        with pytest.raises(ValueError):
            payroll.raise_salaries(employees, 1, bad)
    after, raised = payroll.raise_salaries(employees, 1, Decimal("10"))
    assert [(r.old_salary, r.new_salary, r.increase_amount) for r in raised.collect()] == [
        (Decimal("33.33"), Decimal("36.66"), Decimal("3.33"))
    ]
    assert sorted(r.salary for r in after.collect()) == [
        Decimal("36.66"),
        Decimal(100),
        Decimal(100),
    ]
    assert payroll.raise_reason(1, Decimal(10)) == "Повышение зарплаты отделу 1 на 10%"


def test_vacation_days_of_someone_without_leave(make):
    vacations = make(
        "vacations",
        {"employee_id": 1, "start_date": date(2022, 1, 1), "end_date": date(2022, 1, 5), "days_count": 5, "status": "taken"},
    )
    nobody = payroll.vacation_days(vacations, AS_OF, employee_id=7).collect()
    assert [(r.vacation_type, r.days_taken, r.days_remaining) for r in nobody] == [
        ("total", 0, 28)
    ]
    someone = by(payroll.vacation_days(vacations, AS_OF, 2023, employee_id=1), "vacation_type")
    assert set(someone) == {"annual", "total"}
    assert someone["annual"].days_taken == 0
    assert someone["total"].total_entitled == 28


def test_statistics_without_hires(make):
    assert payroll.year_before(date(2024, 2, 29)) == date(2023, 2, 28)
    rows = payroll.hr_statistics(make("employees"), make("departments"), AS_OF).collect()
    assert {r.metric_name for r in rows} == {labels.TURNOVER, labels.UTILIZATION}


def test_token_search(make):
    projects = make(
        "projects",
        {"project_id": 1, "description": "Создание CRM, для банка"},
        {"project_id": 2, "description": "crm: отчёты банка"},
        {"project_id": 3, "description": None},
    )
    wanted = ["CRM", "банка"]
    direct = {r.project_id for r in listing.token_search(projects, ["description"], wanted).collect()}
    assert direct == {1, 2}


def test_open_sets_reject_unknown_names(make):
    with pytest.raises(ValueError):
        listing.open_set("nothing", make("projects"))


def test_search_without_bounds_finds_every_salary(make):
    tables = (
        make("employees", {"employee_id": 1, "salary": Decimal(20_000_000)}, {"employee_id": 2}),
        make("departments", {"department_id": 1}),
        make("positions", {"position_id": 1}),
        make("employee_skills"),
        make("skills"),
    )
    assert listing.search_employees(*tables).count() == 2
    assert listing.search_employees(*tables, max_salary=10_000_000).count() == 1
