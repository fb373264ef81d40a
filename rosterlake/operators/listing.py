"""Listings, lookups, searches and counts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import arranged, asc, desc, full_name, moment
from .pages import deep_page

#: From this row on a page is read from ranges.
DEEP = 100_000


def page(df: DataFrame, skip: int, limit: int | None, *keys: Column) -> DataFrame:
    """One page in the order of ``keys``, or all that follows ``skip`` without a limit.

    Every task keeps ``skip + limit`` rows, so pages beyond ``DEEP`` rows are read from ranges instead, in which a
    task keeps rows of the page only. For many pages keep the ranges, or go on from the last key seen
    (:func:`pages.save_ranges`, :func:`pages.page_after`).
    """
    if skip >= DEEP:
        return deep_page(df, skip, limit, *keys)
    df = df.orderBy(*keys)
    df = df.offset(skip) if skip else df
    return df if limit is None else df.limit(limit)


def page_summary(df: DataFrame, skip: int, limit: int) -> DataFrame:
    """Total, and whether rows follow the page, for the listing of ``df``."""
    return df.agg(F.count("*").alias("total")).select(
        "total",
        F.lit(skip).alias("skip"),
        F.lit(limit).alias("limit"),
        (F.col("total") > skip + limit).alias("has_more"),
    )


def list_employees(
    employees: DataFrame, department_id: int | None = None, skip: int = 0, limit: int | None = None
) -> DataFrame:
    if department_id:
        employees = employees.filter(F.col("department_id") == department_id)
    return page(employees, skip, limit, asc("employee_id"))


def get_employee(employees: DataFrame, employee_id: int) -> DataFrame:
    return employees.filter(F.col("employee_id") == employee_id)


def list_departments(
    departments: DataFrame, employees: DataFrame, skip: int = 0, limit: int | None = None
) -> DataFrame:
    """A page of departments with active payroll and head count."""
    staff = (
        employees.filter("is_active")
        .groupBy("department_id")
        .agg(F.sum("salary").alias("pay"), F.count("*").alias("heads"))
    )
    chosen = page(departments, skip, limit, asc("department_id"))
    return (
        chosen.join(staff, "department_id", "left")
        .select(
            *[F.col(c) for c in departments.columns],
            F.coalesce("pay", F.lit(0)).alias("total_salary_budget"),
            F.coalesce("heads", F.lit(0)).cast("long").alias("employee_count"),
        )
        .orderBy(asc("department_id"))
    )


def list_positions(positions: DataFrame, skip: int = 0, limit: int | None = None) -> DataFrame:
    return page(positions, skip, limit, asc("position_id"))


def list_audit(
    audit_log: DataFrame,
    table_name: str | None = None,
    operation: str | None = None,
    skip: int = 0,
    limit: int | None = None,
    tie_break: Sequence[str] = ("log_id",),
) -> DataFrame:
    """A page of the audit log, newest first."""
    if table_name:
        audit_log = audit_log.filter(F.col("table_name") == table_name)
    if operation:
        audit_log = audit_log.filter(F.col("operation_type") == operation)
    return page(audit_log, skip, limit, desc("changed_at"), *[asc(c) for c in tie_break])


def department_employees(
    employees: DataFrame, positions: DataFrame, department_id: int, ordered: bool = True
) -> DataFrame:
    """Employees of a department with position and manager."""
    managers = employees.select(
        F.col("employee_id").alias("manager_id"), full_name().alias("manager_name")
    )
    staff = (
        employees.filter(F.col("department_id") == department_id)
        .join(positions.select("position_id", "position_title"), "position_id", "left")
        .join(managers, "manager_id", "left")
        .select(*[F.col(c) for c in employees.columns], "position_title", "manager_name")
    )
    return arranged(staff, ordered, asc("last_name"), asc("first_name"), asc("employee_id"))


def search_employees(
    employees: DataFrame,
    departments: DataFrame,
    positions: DataFrame,
    employee_skills: DataFrame,
    skills: DataFrame,
    department_id: int | None = None,
    position_id: int | None = None,
    min_salary: Decimal | int | None = None,
    max_salary: Decimal | int | None = None,
    skill_ids: Sequence[int] | None = None,
    hired_from: date | None = None,
    hired_to: date | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Active employees by any mix of criteria, with all their skills; None leaves one out.

    Asking for skills finds people who hold any of them; the skill list still
    shows everything they hold. A search that narrows the staff gathers the
    skills of those it found only.
    """
    bounds = [
        (min_salary, lambda x: F.col("salary") >= x),
        (max_salary, lambda x: F.col("salary") <= x),
        (hired_from, lambda x: F.col("hire_date") >= x),
        (hired_to, lambda x: F.col("hire_date") <= x),
    ]
    criteria = [department_id, position_id, skill_ids, *(bound for bound, _ in bounds)]
    narrowed = any(c is not None for c in criteria)
    found = employees.filter("is_active")
    for bound, holds in bounds:
        if bound is not None:
            found = found.filter(holds(F.lit(bound)))
    if department_id is not None:
        found = found.filter(F.col("department_id") == department_id)
    if position_id is not None:
        found = found.filter(F.col("position_id") == position_id)
    held = employee_skills.select("employee_id", "skill_id")
    if skill_ids is not None:
        holders = held.filter(F.col("skill_id").isin(list(skill_ids)))
        found = found.join(holders.select("employee_id").distinct(), "employee_id", "left_semi")
    if narrowed:
        # The new partitioning lets the join split an employee with very many rows.
        held = held.join(found.select("employee_id"), "employee_id", "left_semi").repartition(
            "employee_id", "skill_id"
        )
    gathered = (
        held.distinct()
        .join(skills.select("skill_id", "skill_name"), "skill_id")
        .groupBy("employee_id")
        .agg(F.sort_array(F.collect_set("skill_name")).alias("skills"))
    )
    matched = (
        found.join(departments.select("department_id", "department_name"), "department_id")
        .join(positions.select("position_id", "position_title"), "position_id")
        .join(gathered, "employee_id", "left")
        .select(
            "employee_id",
            full_name().alias("full_name"),
            "email",
            "department_name",
            "position_title",
            "salary",
            "hire_date",
            F.coalesce("skills", F.array().cast("array<string>")).alias("skills"),
            "last_name",
            "first_name",
        )
    )
    return arranged(
        matched, ordered, asc("last_name"), asc("first_name"), asc("employee_id")
    ).drop("last_name", "first_name")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, one row per name; ``active_employees`` is added."""
    if "employees" in tables:
        tables = {**tables, "active_employees": tables["employees"].filter("is_active")}
    counted = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("name"), "row_count"
        )
        counted = part if counted is None else counted.unionByName(part)
    return counted


def filtered_catalog(
    items: DataFrame,
    details: DataFrame,
    on: Column,
    title: str,
    text: str,
    price: str,
    low: float,
    high: float,
    category: str,
    value,
) -> DataFrame:
    """Items by part of the title, price range and category, joined to details."""
    chosen = items.filter(
        F.col(title).contains(text)
        & F.col(price).between(low, high)
        & (F.col(category) == value)
    )
    return chosen.join(details, on)


def filtered_orders(
    orders: DataFrame,
    customers: DataFrame,
    on: Column,
    status_column: str,
    status: str,
    date_column: str,
    start,
    end,
    key: str,
) -> DataFrame:
    """Orders of a status within a period with their customer, newest first.

    ``key`` settles the order within a date, and lets the sort split a busy one.
    """
    chosen = orders.filter(
        (F.col(status_column) == status) & F.col(date_column).between(start, end)
    )
    return chosen.join(customers, on).orderBy(desc(date_column), asc(key))


def open_set(name: str, table: DataFrame, since: datetime | None = None) -> DataFrame:
    """The rows of a table that count as open; the filter reaches the scan."""
    if name == "active_employees":
        return table.filter("is_active")
    if name == "open_projects":
        return table.filter(
            F.col("status").isin("planning", "active") & F.col("end_date").isNull()
        )
    if name == "approved_vacations":
        return table.filter(F.col("status") == "approved")
    if name == "recent_audit":
        return table.filter(F.col("changed_at") > moment(since))
    if name == "open_assignments":
        return table.filter(F.col("end_date").isNull())
    if name == "certified_skills":
        return table.filter("certified")
    raise ValueError(f"unknown set: {name}")


# Fixed value: what separates words; an address stays one word.
WORD_BREAK = r"[^\p{L}\p{N}@._+-]+"


def words(*columns: str) -> Column:
    """The lower-case words of the columns."""
    text = F.concat_ws(" ", *[F.col(c) for c in columns])
    return F.split(F.lower(text), WORD_BREAK)


def token_search(df: DataFrame, columns: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """Rows that hold every wanted word; one pass without a shuffle."""
    tokens = words(*columns)
    match = F.lit(True)
    for word in wanted:
        match = match & F.array_contains(tokens, word.lower())
    return df.filter(match)


def second_highest_paid(employees: DataFrame) -> DataFrame:
    """The second-highest paid employee of every department.

    Every task keeps two rows per department before the shuffle.
    """
    by_pay = Window.partitionBy("department_id").orderBy(desc("salary"), asc("employee_id"))
    return (
        employees.withColumn("place", F.row_number().over(by_pay))
        .filter("place = 2")
        .drop("place")
    )
