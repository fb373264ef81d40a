"""Reports over employees, departments, projects, skills, leave and pay."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import labels
from ..functions.expressions import (
    arranged,
    asc,
    completed_years,
    days_between,
    desc,
    full_name,
    is_open,
    monthly_cost,
    people,
    percent,
)


def _active(employees: DataFrame) -> DataFrame:
    return employees.filter("is_active")


def _with_places(employees: DataFrame, departments: DataFrame, positions: DataFrame) -> DataFrame:
    """Employees with the names of department and position."""
    return employees.join(
        departments.select("department_id", "department_name"), "department_id", "left"
    ).join(positions.select("position_id", "position_title"), "position_id", "left")


def _with_manager_name(employees: DataFrame, everyone: DataFrame) -> DataFrame:
    managers = everyone.select(
        F.col("employee_id").alias("manager_id"), full_name().alias("manager_name")
    )
    return employees.join(managers, "manager_id", "left")


def salary_band(salary: Column, low: Column, high: Column) -> Column:
    """Below, above or within the band; a missing band counts as within."""
    return (
        F.when(salary < low, labels.BELOW_BAND)
        .when(salary > high, labels.ABOVE_BAND)
        .otherwise(labels.WITHIN_BAND)
    )


def employee_details(
    employees: DataFrame,
    departments: DataFrame,
    positions: DataFrame,
    as_of: date,
    ordered: bool = True,
) -> DataFrame:
    """Employees with department, position, manager, tenure, band and activity."""
    managers = people(employees, "manager", "first_name", "last_name", "email")
    detailed = (
        employees.join(
            departments.select(
                "department_id", "department_name", F.col("budget").alias("department_budget")
            ),
            "department_id",
            "left",
        )
        .join(
            positions.select(
                "position_id",
                "position_title",
                "position_level",
                "base_salary_min",
                "base_salary_max",
            ),
            "position_id",
            "left",
        )
        .join(managers, "manager_id", "left")
        .select(
            "employee_id",
            "first_name",
            "last_name",
            "email",
            "phone",
            "hire_date",
            "salary",
            "is_active",
            "department_name",
            "department_budget",
            "position_title",
            "position_level",
            "base_salary_min",
            "base_salary_max",
            "manager_first_name",
            "manager_last_name",
            "manager_email",
            completed_years(F.col("hire_date"), as_of).alias("years_in_company"),
            salary_band(
                F.col("salary"), F.col("base_salary_min"), F.col("base_salary_max")
            ).alias("salary_benchmark"),
            F.when(F.col("is_active"), labels.ACTIVE)
            .otherwise(labels.NOT_ACTIVE)
            .alias("activity_status"),
        )
    )
    return arranged(
        detailed,
        ordered,
        asc("department_name"),
        desc("position_level"),
        asc("last_name"),
        asc("employee_id"),
    )


def department_salary_report(
    departments: DataFrame, employees: DataFrame, positions: DataFrame
) -> DataFrame:
    """Head counts, pay figures, fund against budget and band outliers per department.

    Employees are reduced to one row per department before departments join in.
    """
    active = F.col("is_active")
    pay = F.when(active, F.col("salary"))
    per_department = (
        employees.select("department_id", "position_id", "salary", "is_active")
        .join(
            positions.select("position_id", "base_salary_min", "base_salary_max"),
            "position_id",
            "left",
        )
        .groupBy("department_id")
        .agg(
            F.count("*").alias("total_employees"),
            F.count_if(active).alias("active_employees"),
            F.count_if(~active).alias("inactive_employees"),
            F.sum(pay).alias("fund"),
            F.count(pay).alias("paid"),
            F.min(pay).alias("lowest"),
            F.max(pay).alias("highest"),
            F.count_if(active & (F.col("salary") < F.col("base_salary_min"))).alias("below"),
            F.count_if(active & (F.col("salary") > F.col("base_salary_max"))).alias("above"),
        )
    )
    fund = F.coalesce(F.col("fund"), F.lit(0))
    zero = F.lit(0)
    return (
        departments.select("department_id", "department_name", "budget")
        .join(per_department, "department_id", "left")
        .select(
            "department_id",
            "department_name",
            "budget",
            *[
                F.coalesce(F.col(c), zero).cast("long").alias(c)
                for c in ("total_employees", "active_employees", "inactive_employees")
            ],
            fund.alias("total_salary_fund"),
            F.coalesce(F.col("fund") / F.nullif(F.col("paid"), zero), zero).alias("avg_salary"),
            F.coalesce(F.col("lowest"), zero).alias("min_salary"),
            F.coalesce(F.col("highest"), zero).alias("max_salary"),
            percent(fund, F.col("budget")).alias("salary_to_budget_percentage"),
            F.coalesce(F.col("below"), zero).cast("long").alias("below_min_salary"),
            F.coalesce(F.col("above"), zero).cast("long").alias("above_max_salary"),
        )
        .orderBy(desc("total_salary_fund"), asc("department_id"))
    )


def project_resource_report(
    projects: DataFrame,
    employee_projects: DataFrame,
    employees: DataFrame,
    departments: DataFrame,
    as_of: date,
) -> DataFrame:
    """Team size, load, monthly cost, progress and dated status per project.

    Assignments are first reduced to one row per project and employee, which
    spreads a large project over many groups and makes the distinct counts plain
    counts. Money stays an exact sum; the only division comes last.
    """
    today = F.lit(as_of)
    share = F.col("participation_percentage")
    rated = F.col("hourly_rate").isNotNull()
    members = employee_projects.groupBy("project_id", "employee_id").agg(
        F.max(is_open(F.col("end_date"), as_of)).alias("current"),
        F.sum(share).alias("share_sum"),
        F.count(share).alias("share_count"),
        F.sum((F.col("hourly_rate") * share).cast("decimal(18,2)")).alias("rate_points"),
        F.sum(F.when(~rated, share)).alias("salary_points"),
    )
    teams = (
        members.join(employees.select("employee_id", "salary"), "employee_id", "left")
        .groupBy("project_id")
        .agg(
            F.count("*").alias("total_team_members"),
            F.count_if("current").alias("current_team_members"),
            F.sum("share_sum").alias("total_participation_percentage"),
            F.sum("share_count").alias("share_count"),
            F.sum("rate_points").cast("decimal(30,2)").alias("rate_points"),
            F.sum((F.col("salary") * F.col("salary_points")).cast("decimal(24,2)"))
            .cast("decimal(30,2)")
            .alias("salary_points"),
        )
    )
    cost = monthly_cost(F.col("rate_points"), F.col("salary_points"))
    length = days_between(F.col("start_date"), F.col("end_date"))
    elapsed = days_between(F.col("start_date"), today)
    progress = F.round(
        F.greatest(
            F.lit(0),
            F.least(
                F.lit(100),
                elapsed.cast("decimal(10,0)") * 100 / F.nullif(length, F.lit(0)),
            ),
        ),
        1,
    )
    leads = people(employees, "project_manager", "first_name", "last_name", "email")
    # Order of the statuses in the report.
    rank = (
        F.when(F.col("status") == "active", 1)
        .when(F.col("status") == "planning", 2)
        .when(F.col("status") == "on_hold", 3)
        .when(F.col("status") == "completed", 4)
        .otherwise(5)
    )
    return (
        projects.join(teams, "project_id", "left")
        .join(departments.select("department_id", "department_name"), "department_id", "left")
        .join(leads, "project_manager_id", "left")
        .select(
            "project_id",
            "project_name",
            "start_date",
            "end_date",
            "budget",
            "status",
            "department_name",
            full_name("project_manager_").alias("project_manager"),
            "project_manager_email",
            F.coalesce("total_team_members", F.lit(0)).cast("long").alias("total_team_members"),
            F.coalesce("current_team_members", F.lit(0))
            .cast("long")
            .alias("current_team_members"),
            F.round(
                F.col("total_participation_percentage").cast("decimal(20,0)")
                / F.nullif(F.col("share_count"), F.lit(0)),
                1,
            ).alias("avg_participation_percentage"),
            "total_participation_percentage",
            F.coalesce(cost, F.lit(0)).alias("estimated_monthly_cost"),
            F.when(F.col("end_date").isNotNull(), progress).alias("progress_percentage"),
            dated_project_status(F.col("status"), F.col("end_date"), as_of).alias(
                "project_status_detailed"
            ),
        )
        .orderBy(rank, F.col("end_date").asc_nulls_first(), asc("project_id"))
    )


def dated_project_status(status: Column, end_date: Column, as_of: date) -> Column:
    today = F.lit(as_of)
    return (
        F.when(end_date < today, labels.OVERDUE)
        .when(end_date < F.date_add(today, 7), labels.URGENT)
        .when(status == "active", labels.IN_PROGRESS)
        .otherwise(status)
    )


# Levels of skill and the report columns that carry them.
LEVELS = {
    "beginner": ("beginners", "avg_salary_beginner"),
    "intermediate": ("intermediate", "avg_salary_intermediate"),
    "advanced": ("advanced", "avg_salary_advanced"),
    "expert": ("experts", "avg_salary_expert"),
}


def _top_three(rank: str, name: str) -> Column:
    """The names ranked one to three within a group, in order."""
    return F.array_compact(
        F.array(*[F.max(F.when(F.col(rank) == place, F.col(name))) for place in (1, 2, 3)])
    )


def skill_analytics(
    skills: DataFrame, employee_skills: DataFrame, employees: DataFrame, departments: DataFrame
) -> DataFrame:
    """Holders, certificates, levels, pay per level and top departments per skill.

    One flow: rows to (skill, employee), then to (skill, department), where the
    departments are ranked, then to skills. A skill held by a third of the
    company never meets in one task before it is down to its departments.
    """
    level = F.col("proficiency_level")
    held = employee_skills.groupBy("skill_id", "employee_id").agg(
        F.max(F.coalesce("certified", F.lit(False))).alias("certified"),
        *[F.count_if(level == name).alias(name) for name in LEVELS],
    )
    staff = _active(employees).select(
        "employee_id", "salary", "department_id", F.lit(True).alias("working")
    )
    per_department = (
        held.join(staff, "employee_id", "left")
        .groupBy("skill_id", "department_id")
        .agg(
            F.count("*").alias("holders"),
            F.count("working").alias("working"),
            F.count_if("certified").alias("certified"),
            *[F.count_if(F.col(name) > 0).alias(f"{name}_holders") for name in LEVELS],
            *[
                F.sum((F.col("salary") * F.col(name)).cast("decimal(20,2)")).alias(f"{name}_pay")
                for name in LEVELS
            ],
            *[
                F.sum(F.when(F.col("working"), F.col(name))).alias(f"{name}_paid")
                for name in LEVELS
            ],
        )
        .join(departments.select("department_id", "department_name"), "department_id", "left")
    )
    place = Window.partitionBy("skill_id").orderBy(
        F.col("department_name").isNull(), F.col("working").desc(), asc("department_name")
    )
    per_skill = (
        per_department.withColumn("place", F.row_number().over(place))
        .groupBy("skill_id")
        .agg(
            F.sum("holders").alias("employees_with_skill"),
            F.sum("certified").alias("certified_employees"),
            *[F.sum(f"{n}_holders").alias(LEVELS[n][0]) for n in LEVELS],
            *[
                F.round(
                    F.sum(f"{n}_pay").cast("decimal(30,2)")
                    / F.nullif(F.sum(f"{n}_paid"), F.lit(0)),
                    2,
                ).alias(LEVELS[n][1])
                for n in LEVELS
            ],
            _top_three("place", "department_name").alias("top_departments"),
        )
    )
    counts = ["employees_with_skill", "certified_employees", *[c for c, _ in LEVELS.values()]]
    return (
        skills.select("skill_id", "skill_name", "category")
        .join(per_skill, "skill_id", "left")
        .select(
            "skill_id",
            "skill_name",
            "category",
            *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
            *[avg for _, avg in LEVELS.values()],
            F.coalesce("top_departments", F.array().cast("array<string>")).alias(
                "top_departments"
            ),
        )
        .orderBy(desc("employees_with_skill"), asc("category"), asc("skill_name"))
    )


def vacation_calendar(
    vacations: DataFrame,
    employees: DataFrame,
    departments: DataFrame,
    positions: DataFrame,
    as_of: date,
    ordered: bool = True,
) -> DataFrame:
    """Approved and taken leave with people, places, timeline and alert."""
    today = F.lit(as_of)
    approvers = people(employees, "approver", "first_name", "last_name", "email")
    staff = _with_places(
        employees.select(
            "employee_id", "first_name", "last_name", "email", "department_id", "position_id"
        ),
        departments,
        positions,
    )
    leave = vacations.filter(F.col("status").isin("approved", "taken")).select(
        "vacation_id",
        "employee_id",
        "vacation_type",
        "start_date",
        "end_date",
        "days_count",
        "status",
        F.col("approved_by").alias("approver_id"),
    )
    calendar = (
        leave.join(staff, "employee_id")
        .join(approvers, "approver_id", "left")
        .select(
            "vacation_id",
            "start_date",
            "end_date",
            "days_count",
            "vacation_type",
            "status",
            "employee_id",
            full_name().alias("employee_name"),
            F.col("email").alias("employee_email"),
            "department_name",
            "position_title",
            full_name("approver_").alias("approved_by_name"),
            F.col("approver_email").alias("approved_by_email"),
            F.when(F.col("start_date") > today, labels.PLANNED)
            .when(F.col("end_date") < today, labels.FINISHED)
            .otherwise(labels.CURRENT)
            .alias("vacation_timeline"),
            F.when(F.col("days_count") > 30, labels.LONG_LEAVE)
            .when(
                (days_between(today, F.col("end_date")) < 7) & (F.col("status") == "approved"),
                labels.STARTS_SOON,
            )
            .otherwise(labels.NORMAL)
            .alias("vacation_alert"),
            "last_name",
        )
    )
    return arranged(
        calendar,
        ordered,
        asc("start_date"),
        asc("department_name"),
        asc("last_name"),
        asc("vacation_id"),
    ).drop("last_name")


def salary_change_analysis(
    salary_history: DataFrame, employees: DataFrame, departments: DataFrame
) -> DataFrame:
    """Raises per month with the three leading reasons and departments.

    One flow from rows to (month, employee) to (month, department) to months;
    reasons take a second, two-column scan that collapses before its shuffle.
    """
    raised = F.col("new_salary") - F.col("old_salary")
    dated = salary_history.withColumn("change_month", F.trunc("change_date", "month"))
    per_employee = dated.groupBy("change_month", "employee_id").agg(
        F.count("*").alias("changes"),
        F.sum(raised).alias("amount"),
        F.sum(
            (raised * 100 / F.nullif(F.col("old_salary"), F.lit(0))).cast("decimal(28,12)")
        ).alias("percents"),
        F.count(F.nullif(F.col("old_salary"), F.lit(0))).alias("percent_count"),
    )
    per_department = (
        per_employee.join(employees.select("employee_id", "department_id"), "employee_id", "left")
        .groupBy("change_month", "department_id")
        .agg(
            F.count("*").alias("employees"),
            F.sum("changes").alias("changes"),
            F.sum("amount").alias("amount"),
            F.sum("percents").alias("percents"),
            F.sum("percent_count").alias("percent_count"),
        )
        .join(departments.select("department_id", "department_name"), "department_id", "left")
    )
    by_changes = Window.partitionBy("change_month").orderBy(
        F.col("department_name").isNull(), F.col("changes").desc(), asc("department_name")
    )
    months = (
        per_department.withColumn("place", F.row_number().over(by_changes))
        .groupBy("change_month")
        .agg(
            F.sum("employees").alias("employees_with_changes"),
            F.sum("changes").alias("total_changes"),
            F.round(
                F.sum("percents").cast("decimal(32,12)")
                / F.nullif(F.sum("percent_count"), F.lit(0)),
                2,
            ).alias("avg_percentage_increase"),
            F.round(F.sum("amount").cast("decimal(30,2)") / F.sum("changes"), 2).alias(
                "avg_amount_increase"
            ),
            F.sum("amount").alias("total_salary_increase"),
            _top_three("place", "department_name").alias("top_departments"),
        )
    )
    by_count = Window.partitionBy("change_month").orderBy(
        F.col("n").desc(), asc("change_reason")
    )
    reasons = (
        dated.groupBy("change_month", "change_reason")
        .agg(F.count("*").alias("n"))
        .withColumn("place", F.row_number().over(by_count))
        .filter("place <= 3")
        .groupBy("change_month")
        .agg(_top_three("place", "change_reason").alias("top_reasons"))
    )
    month = F.col("change_month")
    return (
        months.join(reasons, "change_month", "left")
        .select(
            "change_month",
            F.concat(
                F.rpad(F.date_format(month, "MMMM"), 9, " "), F.date_format(month, " yyyy")
            ).alias("month_name"),
            "employees_with_changes",
            "total_changes",
            "avg_percentage_increase",
            "avg_amount_increase",
            "total_salary_increase",
            "top_reasons",
            "top_departments",
        )
        .orderBy(desc("change_month"))
    )


def _in_one_row(*parts: DataFrame) -> DataFrame:
    """One-row frames side by side, by stacking and folding them."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def hr_dashboard(
    employees: DataFrame,
    departments: DataFrame,
    projects: DataFrame,
    vacations: DataFrame,
    as_of: date,
) -> DataFrame:
    """Company figures in one row; every table is read once."""
    today = F.lit(as_of)
    active = F.col("is_active")
    pay = F.when(active, F.col("salary"))

    def same_year(column: str) -> Column:
        return F.year(column) == as_of.year

    staff = employees.agg(
        F.count_if(active).alias("total_active_employees"),
        F.sum(pay).alias("total_salary_fund"),
        (F.sum(pay) / F.nullif(F.count(pay), F.lit(0))).alias("company_avg_salary"),
        F.count_if(same_year("hire_date")).alias("hires_this_year"),
        F.count_if(same_year("hire_date") & (F.month("hire_date") == as_of.month)).alias(
            "hires_this_month"
        ),
        F.count_if(~active & same_year("updated_at")).alias("terminations_this_year"),
    )
    budgets = departments.agg(
        F.count("*").alias("total_departments"), F.sum("budget").alias("total_company_budget")
    )
    work = projects.agg(F.count_if(F.col("status") == "active").alias("active_projects"))
    leave = vacations.agg(
        F.count_if(
            (F.col("status") == "approved")
            & (F.col("start_date") <= today)
            & (F.col("end_date") >= today)
        ).alias("employees_on_vacation_today")
    )
    return _in_one_row(staff, budgets, work, leave).select(
        "total_active_employees",
        "total_departments",
        "active_projects",
        "company_avg_salary",
        "hires_this_year",
        "hires_this_month",
        "terminations_this_year",
        "employees_on_vacation_today",
        "total_company_budget",
        "total_salary_fund",
        percent(F.col("total_salary_fund"), F.col("total_company_budget")).alias(
            "salary_to_budget_percentage_company"
        ),
    )


def employee_info(
    employees: DataFrame, departments: DataFrame, ordered: bool = True
) -> DataFrame:
    """Employees with department and the full name of the manager."""
    named = _with_manager_name(employees, employees).join(
        departments.select("department_id", "department_name"), "department_id", "left"
    )
    return arranged(
        named.select(
            "employee_id",
            full_name().alias("full_name"),
            "email",
            "department_name",
            "manager_name",
        ),
        ordered,
        asc("full_name"),
        asc("employee_id"),
    )


def department_budget(departments: DataFrame, employees: DataFrame) -> DataFrame:
    """Budget and active payroll per department, largest payroll first."""
    payroll = (
        _active(employees).groupBy("department_id").agg(F.sum("salary").alias("total_salary"))
    )
    return (
        departments.select("department_id", "department_name", "budget")
        .join(payroll, "department_id", "left")
        .select("department_id", "department_name", "budget", "total_salary")
        .orderBy(desc("total_salary"), asc("department_id"))
    )


def employee_manager_list(
    employees: DataFrame, departments: DataFrame, positions: DataFrame, ordered: bool = True
) -> DataFrame:
    """Employees with position, department and manager."""
    listed = _with_manager_name(
        _with_places(employees, departments, positions), employees
    ).select(
        "employee_id",
        full_name().alias("employee_name"),
        "position_id",
        "position_title",
        "department_name",
        "manager_name",
        "manager_id",
        "last_name",
    )
    return arranged(
        listed, ordered, asc("department_name"), asc("last_name"), asc("employee_id")
    ).drop("last_name")


def hierarchy_sample(
    employees: DataFrame, departments: DataFrame, positions: DataFrame, n: int = 10
) -> DataFrame:
    """The first ``n`` employees by department and salary, with manager or a note.

    The top-k comes first, so the joins look up ``n`` rows.
    """
    by_pay = [asc("department_id"), desc("salary"), asc("employee_id")]
    first = employees.orderBy(*by_pay).limit(n)
    named = _with_manager_name(_with_places(first, departments, positions), employees)
    return named.orderBy(*by_pay).select(
        full_name().alias("employee"),
        "position_title",
        "department_name",
        F.when(F.col("manager_id").isNull(), labels.NO_MANAGER)
        .otherwise(F.col("manager_name"))
        .alias("manager"),
    )


def _payroll(employees: DataFrame) -> DataFrame:
    """Head count, sum and number of salaries per department."""
    return employees.groupBy("department_id").agg(
        F.count("*").alias("employee_count"),
        F.sum("salary").alias("total_salary"),
        F.count("salary").alias("paid"),
    )


def _average(total: str, paid: str) -> Column:
    return F.col(total) / F.nullif(F.col(paid), F.lit(0))


def department_statistics(departments: DataFrame, employees: DataFrame) -> DataFrame:
    """Active head count and pay per department, zero where nobody works."""
    zero = F.lit(0)
    return (
        departments.select("department_id", "department_name", "budget")
        .join(_payroll(_active(employees)), "department_id", "left")
        .select(
            "department_name",
            F.coalesce("employee_count", zero).cast("long").alias("total_employees"),
            F.coalesce("total_salary", zero).alias("total_salary_fund"),
            F.coalesce(_average("total_salary", "paid"), zero).alias("avg_salary"),
            "budget",
        )
        .orderBy(desc("total_salary_fund"), asc("department_name"))
    )


def department_payroll(departments: DataFrame, employees: DataFrame) -> DataFrame:
    """Payroll over all staff per department; empty departments come first."""
    return (
        departments.select("department_id", "department_name")
        .join(_payroll(employees), "department_id", "left")
        .select(
            "department_id",
            "department_name",
            F.coalesce("employee_count", F.lit(0)).cast("long").alias("employee_count"),
            "total_salary",
            _average("total_salary", "paid").alias("avg_salary"),
        )
        .orderBy(desc("total_salary"), asc("department_id"))
    )


def employee_statistics(employees: DataFrame, departments: DataFrame) -> DataFrame:
    """Company totals and their distribution over departments.

    One row per department and one for the company (department NULL), so the
    distribution never has to fit into a single value.
    """
    active = F.col("is_active")
    pay = F.when(active, F.col("salary"))
    per_department = employees.groupBy("department_id").agg(
        F.count("*").alias("total_employees"),
        F.count_if(active).alias("active_employees"),
        F.sum(pay).alias("total_salary_budget"),
        F.count(pay).alias("paid"),
    )
    measures = ["total_employees", "active_employees", "total_salary_budget", "paid"]
    rolled = (
        per_department.rollup("department_id")
        .agg(*[F.sum(m).alias(m) for m in measures], F.grouping("department_id").alias("g"))
        .withColumn("scope", F.when(F.col("g") == 1, "company").otherwise("department"))
    )
    return (
        rolled.join(
            departments.select("department_id", "department_name"), "department_id", "left"
        )
        .select(
            "scope",
            "department_id",
            "department_name",
            "total_employees",
            "active_employees",
            F.coalesce("total_salary_budget", F.lit(0)).alias("total_salary_budget"),
            F.coalesce(
                F.col("total_salary_budget").cast("decimal(30,2)")
                / F.nullif(F.col("paid"), F.lit(0)),
                F.lit(0),
            ).alias("avg_salary"),
        )
        .orderBy(asc("scope"), asc("department_id"))
    )


def project_load(projects: DataFrame, employee_projects: DataFrame) -> DataFrame:
    """Members and summed participation per project."""
    load = (
        employee_projects.groupBy("project_id", "employee_id")
        .agg(F.sum("participation_percentage").alias("allocation"))
        .groupBy("project_id")
        .agg(
            F.count("employee_id").alias("total_employees"),
            F.sum("allocation").alias("allocation_sum"),
        )
    )
    return (
        projects.select("project_id", "project_name", "status")
        .join(load, "project_id", "left")
        .select(
            "project_id",
            "project_name",
            F.coalesce("total_employees", F.lit(0)).alias("total_employees"),
            F.coalesce("allocation_sum", F.lit(0)).alias("allocation_sum"),
            "status",
        )
        .orderBy(asc("project_id"))
    )
