"""Salary funds, hiring checks, raises, project cost, statistics, leave, tenure."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import labels
from ..sources.scratch import write_and_read
from .expressions import (
    arranged,
    asc,
    compare,
    days_between,
    desc,
    full_name,
    is_open,
    monthly_cost,
    percent,
)

# Share of the budget that pay may use, leave days per year.
FUND_LIMIT = Decimal("0.7")
LEAVE_DAYS = 28


def active_funds(employees: DataFrame) -> DataFrame:
    """Active payroll per department that has active staff."""
    return (
        employees.filter("is_active").groupBy("department_id").agg(F.sum("salary").alias("fund"))
    )


def budget_room(departments: DataFrame, employees: DataFrame) -> DataFrame:
    """Budget and fund per department, written out.

    Joined as written it has a known size: small, it is broadcast and the rows it
    joins stay where they are; large, it is shuffled on its own, which lets a
    department that holds much of those rows be split.
    """
    return write_and_read(
        departments.select("department_id", "budget").join(
            active_funds(employees), "department_id", "left"
        ),
        "room",
    )


def department_fund(
    departments: DataFrame, employees: DataFrame, department_id: int | None = None
) -> DataFrame:
    """Active payroll of every department, or of one; 0 where nobody is paid."""
    if department_id is not None:
        departments = departments.filter(F.col("department_id") == department_id)
        employees = employees.filter(F.col("department_id") == department_id)
    return departments.select("department_id").join(
        active_funds(employees), "department_id", "left"
    ).select(
        "department_id",
        F.coalesce("fund", F.lit(0)).cast("decimal(15,2)").alias("total_fund"),
    )


def check_hire(candidates: DataFrame, departments: DataFrame, employees: DataFrame) -> DataFrame:
    """Whether each candidate alone would keep the fund within the limit.

    ``candidates`` needs ``department_id`` and ``salary``; an unknown department
    gives NULL.
    """
    room = budget_room(departments, employees)
    fund = F.coalesce("fund", F.lit(0))
    return candidates.join(room, "department_id", "left").select(
        *[F.col(c) for c in candidates.columns],
        (fund + F.col("salary") <= F.col("budget") * F.lit(FUND_LIMIT)).alias(
            "within_budget"
        ),
    )


def raise_reason(department_id: int, percentage: Decimal) -> str:
    """The reason a department-wide raise leaves in the salary history."""
    return labels.RAISE_REASON.format(department_id, percentage)


def raise_salaries(
    employees: DataFrame, department_id: int, percentage: Decimal, ordered: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Raise the active staff of a department; returns (employees, changes)."""
    percentage = Decimal(percentage)
    if not 0 < percentage <= 100:
        raise ValueError(labels.RAISE_BOUNDS)
    raised = (F.col("department_id") == department_id) & F.col("is_active")
    new_salary = F.round(F.col("salary") * F.lit(1 + percentage / 100), 2).cast("decimal(12,2)")
    after = employees.withColumn(
        "salary", F.when(raised, new_salary).otherwise(F.col("salary"))
    )
    changes = employees.filter(raised).select(
        "employee_id",
        full_name().alias("employee_name"),
        F.col("salary").alias("old_salary"),
        new_salary.alias("new_salary"),
        (new_salary - F.col("salary")).alias("increase_amount"),
    )
    return after, arranged(changes, ordered, desc("increase_amount"), asc("employee_id"))


def project_cost(
    projects: DataFrame,
    employee_projects: DataFrame,
    employees: DataFrame,
    as_of: date,
    project_id: int | None = None,
) -> DataFrame:
    """People and other cost per project, with the share of the budget.

    Assignments are reduced to (project, employee) before salaries join in.
    """
    if project_id is not None:
        projects = projects.filter(F.col("project_id") == project_id)
        employee_projects = employee_projects.filter(F.col("project_id") == project_id)
    share = F.col("participation_percentage")
    unrated = F.col("hourly_rate").isNull()
    people = (
        employee_projects.filter(is_open(F.col("end_date"), as_of))
        .groupBy("project_id", "employee_id")
        .agg(
            F.sum((F.col("hourly_rate") * share).cast("decimal(18,2)")).alias("rate_points"),
            F.sum(F.when(unrated, share)).alias("salary_points"),
        )
        .join(employees.filter("is_active").select("employee_id", "salary"), "employee_id")
        .groupBy("project_id")
        .agg(
            F.sum("rate_points").cast("decimal(30,2)").alias("rate_points"),
            F.sum((F.col("salary") * F.col("salary_points")).cast("decimal(24,2)"))
            .cast("decimal(30,2)")
            .alias("salary_points"),
        )
    )
    cost = F.coalesce(
        monthly_cost(F.col("rate_points"), F.col("salary_points")), F.lit(0)
    ).cast("decimal(24,6)")
    costs = (
        projects.select("project_id", "budget")
        .join(people, "project_id", "left")
        .withColumn("people", cost)
        .withColumn("other", F.col("budget") - F.col("people"))
    )
    components = F.inline(
        F.array(
            F.struct(
                F.lit(labels.PEOPLE_COST).alias("cost_component"),
                F.col("people").cast("decimal(26,6)").alias("amount"),
            ),
            F.struct(
                F.lit(labels.OTHER_COST).alias("cost_component"),
                F.col("other").cast("decimal(26,6)").alias("amount"),
            ),
        )
    )
    return costs.select("project_id", "budget", components).select(
        "project_id",
        "cost_component",
        F.round("amount", 2).cast("decimal(15,2)").alias("amount"),
        percent(F.col("amount"), F.col("budget")).alias("percentage_of_budget"),
    )


def _hires_by_month(employees: DataFrame, start: date, end: date) -> DataFrame:
    """Active hires of the newest month with the figures of the month before it.

    The window runs over one row per month.
    """
    months = (
        employees.filter(F.col("is_active") & F.col("hire_date").between(start, end))
        .groupBy(F.trunc("hire_date", "month").alias("month"))
        .agg(
            F.count("*").alias("hires"),
            (F.sum("salary") / F.nullif(F.count("salary"), F.lit(0))).alias("pay"),
        )
    )
    in_time = Window.orderBy("month")
    return (
        months.withColumn("hires_before", F.lag("hires", 1, 0).over(in_time))
        .withColumn(
            "pay_before",
            F.when(F.row_number().over(in_time) == 1, F.lit(0)).otherwise(
                F.lag("pay").over(in_time)
            ),
        )
        .orderBy(F.col("month").desc())
        .limit(1)
    )


def _metric(name: str, value, unit: str, trend):
    return F.struct(
        F.lit(name).alias("metric_name"),
        value.cast("decimal(20,2)").alias("metric_value"),
        F.lit(unit).alias("metric_unit"),
        trend.alias("trend"),
    )


def _hires_metric():
    return _metric(
        labels.NEW_HIRES,
        F.col("hires"),
        labels.PEOPLE_UNIT,
        compare(F.col("hires"), F.col("hires_before"), labels.UP, labels.DOWN, labels.STABLE),
    )


def _pay_metric():
    return _metric(
        labels.AVERAGE_SALARY,
        F.round("pay", 2),
        labels.MONEY_UNIT,
        compare(F.col("pay"), F.col("pay_before"), labels.UP, labels.DOWN, labels.STABLE),
    )


def new_hires(employees: DataFrame, start: date, end: date) -> DataFrame:
    """Active hires in the newest month of the period, against the month before."""
    return _hires_by_month(employees, start, end).select(F.inline(F.array(_hires_metric())))


def avg_hire_salary(employees: DataFrame, start: date, end: date) -> DataFrame:
    """Average salary of that month's hires, against the month before."""
    return _hires_by_month(employees, start, end).select(F.inline(F.array(_pay_metric())))


def turnover(employees: DataFrame, start: date, end: date) -> DataFrame:
    """Inactive share of those hired, or gone, within the period."""
    gone = ~F.col("is_active")
    updated = F.col("updated_at").between(F.lit(start), F.lit(end))
    rate = percent(F.count_if(gone), F.count("*"))
    return (
        employees.filter(F.col("hire_date").between(start, end) | (gone & updated))
        .agg(rate.alias("rate"))
        .select(
            F.inline(
                F.array(
                    _metric(
                        labels.TURNOVER,
                        F.col("rate"),
                        labels.PERCENT_UNIT,
                        F.when(F.col("rate") > 10, labels.TURNOVER_HIGH)
                        .when(F.col("rate") < 5, labels.TURNOVER_LOW)
                        .otherwise(labels.TURNOVER_MEDIUM),
                    )
                )
            )
        )
    )


def department_utilization(departments: DataFrame, employees: DataFrame) -> DataFrame:
    """Mean fund share of the budget over departments with active staff."""
    share = (
        F.coalesce(F.col("fund"), F.lit(0)).cast("decimal(20,2)")
        * 100
        / F.nullif(F.col("budget"), F.lit(0))
    ).cast("decimal(24,10)")
    return (
        departments.select("department_id", "budget")
        .join(active_funds(employees), "department_id")
        .agg(F.avg(share).alias("rate"))
        .select(
            F.inline(
                F.array(
                    _metric(
                        labels.UTILIZATION,
                        F.round("rate", 2),
                        labels.PERCENT_UNIT,
                        F.when(F.col("rate") > 65, labels.OVERLOADED)
                        .when(F.col("rate") < 40, labels.UNDERLOADED)
                        .otherwise(labels.OPTIMAL),
                    )
                )
            )
        )
    )


def year_before(day: date) -> date:
    """The same day a year earlier; 28 February for a leap day."""
    if (day.month, day.day) == (2, 29):
        return date(day.year - 1, 2, 28)
    return day.replace(year=day.year - 1)


def hr_statistics(
    employees: DataFrame,
    departments: DataFrame,
    as_of: date,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """The four metrics over a period, the last year unless given.

    Hires and their pay come out of one scan.
    """
    start, end = start or year_before(as_of), end or as_of
    hires = _hires_by_month(employees, start, end).select(
        F.inline(F.array(_hires_metric(), _pay_metric()))
    )
    return hires.unionByName(turnover(employees, start, end)).unionByName(
        department_utilization(departments, employees)
    )


def vacation_days(
    vacations: DataFrame, as_of: date, year: int | None = None, employee_id: int | None = None
) -> DataFrame:
    """Leave taken, planned and left per employee and type, with a total row.

    A type taken in another year still shows with 0 days. For one employee
    without any leave the total row shows the full entitlement.
    """
    year = year or as_of.year
    leave = vacations.filter(F.col("status").isin("taken", "approved"))
    if employee_id is not None:
        leave = leave.filter(F.col("employee_id") == employee_id)
    this_year = F.year("start_date") == year
    taken = F.when((F.col("status") == "taken") & this_year, F.col("days_count")).otherwise(0)
    planned = F.when(
        (F.col("status") == "approved") & (F.col("start_date") > F.lit(as_of)) & this_year,
        F.col("days_count"),
    ).otherwise(0)
    grouped = leave.groupingSets(
        [["employee_id", "vacation_type"], ["employee_id"]], "employee_id", "vacation_type"
    ).agg(
        F.grouping("vacation_type").alias("is_total"),
        F.sum(taken).alias("days_taken"),
        F.sum(planned).alias("days_planned"),
    )
    if employee_id is not None:
        # One constant row, so that an employee without leave has a total too.
        nothing = vacations.sparkSession.range(1).select(
            F.lit(employee_id).cast("long").alias("employee_id"),
            F.lit(None).cast("string").alias("vacation_type"),
            F.lit(1).cast("tinyint").alias("is_total"),
            F.lit(0).cast("long").alias("days_taken"),
            F.lit(0).cast("long").alias("days_planned"),
        )
        grouped = (
            grouped.unionByName(nothing)
            .groupBy("employee_id", "vacation_type", "is_total")
            .agg(F.sum("days_taken").alias("days_taken"), F.sum("days_planned").alias("days_planned"))
        )
    return grouped.select(
        "employee_id",
        F.when(F.col("is_total") == 1, F.lit("total"))
        .otherwise(F.coalesce("vacation_type", F.lit("annual")))
        .alias("vacation_type"),
        "days_taken",
        "days_planned",
        (F.lit(LEAVE_DAYS) - F.col("days_taken") - F.col("days_planned")).alias("days_remaining"),
        F.lit(LEAVE_DAYS).alias("total_entitled"),
    )


def tenure(employees: DataFrame, as_of: date, employee_id: int | None = None) -> DataFrame:
    """Whole years of 365 days since hiring."""
    if employee_id is not None:
        employees = employees.filter(F.col("employee_id") == employee_id)
    days = days_between(F.col("hire_date"), F.lit(as_of))
    return employees.select(
        "employee_id",
        full_name().alias("full_name"),
        "hire_date",
        F.floor(days / 365).cast("int").alias("tenure_years"),
    )
