"""Filling gaps: heads, managers, positions, skills and projects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import labels
from ..sources.scratch import write_and_read


def fill_department_heads(departments: DataFrame, employees: DataFrame) -> DataFrame:
    """Departments without head get their best paid employee."""
    best = employees.groupBy("department_id").agg(
        F.max_by("employee_id", F.struct("salary", -F.col("employee_id"))).alias("best_paid")
    )
    return departments.join(best, "department_id", "left").select(
        *[
            F.coalesce("manager_id", "best_paid").alias(c) if c == "manager_id" else F.col(c)
            for c in departments.columns
        ]
    )


def fill_managers(
    employees: DataFrame, departments: DataFrame, leading_department: int = 1
) -> DataFrame:
    """Staff without manager report to their head, heads to the leading department's."""
    heads = departments.select("department_id", F.col("manager_id").alias("head"))
    other_heads = (
        departments.filter(F.col("department_id") > leading_department)
        .select(F.col("manager_id").alias("employee_id"))
        .distinct()
        .withColumn("leads", F.lit(True))
    )
    leader = (
        departments.filter(F.col("department_id") == leading_department)
        .select("manager_id")
        .scalar()
    )
    me = F.col("employee_id")
    return (
        employees.join(heads, "department_id", "left")
        .join(other_heads, "employee_id", "left")
        .select(
            *[
                F.coalesce(
                    "manager_id",
                    F.nullif(F.col("head"), me),
                    F.when(F.col("leads"), F.nullif(leader, me)),
                ).alias(c)
                if c == "manager_id"
                else F.col(c)
                for c in employees.columns
            ]
        )
    )


# Least salary, part of the department name, position. First match wins.
POSITION_RULES: list[tuple[int, str, int]] = [
    (250_000, "", 1),
    (200_000, "Руковод", 1),
    (200_000, "ИТ", 2),
    (180_000, "Финан", 3),
    (150_000, "Разраб", 4),
    (150_000, "Продаж", 6),
    (120_000, "ИТ", 7),
    (90_000, "ИТ", 8),
    (80_000, "Бухгал", 14),
    (70_000, "Продаж", 12),
    (65_000, "Маркет", 13),
    (60_000, "Кадр", 15),
    (50_000, "ИТ", 9),
    (40_000, "Поддерж", 16),
    (35_000, "", 18),
]
DEFAULT_POSITION = 18


def assign_positions(employees: DataFrame, departments: DataFrame) -> DataFrame:
    """Employees without position get one by salary and department name."""
    by_rule = F.lit(None).cast("long")
    for least, part, position in reversed([*POSITION_RULES, (None, "", DEFAULT_POSITION)]):
        if least is None:
            by_rule = F.lit(position).cast("long")
            continue
        match = F.col("salary") >= least
        if part:
            match = match & F.col("department_name").contains(part)
        by_rule = F.when(match, F.lit(position).cast("long")).otherwise(by_rule)
    known = F.col("department_name").isNotNull()
    return employees.join(
        departments.select("department_id", "department_name"), "department_id", "left"
    ).select(
        *[
            F.coalesce("position_id", F.when(known, by_rule)).alias(c)
            if c == "position_id"
            else F.col(c)
            for c in employees.columns
        ]
    )


def by_salary(steps: Sequence[tuple[int, str]], otherwise: str) -> Column:
    """The first text whose least salary is reached."""
    chosen = F.lit(otherwise)
    for least, text in reversed(steps):
        chosen = F.when(F.col("salary") >= least, text).otherwise(chosen)
    return chosen


def numbered_in_group(df: DataFrame, group: str, key: str) -> DataFrame:
    """Adds ``slot`` 0, 1, 2 … in key order within each group, and ``group_size``.

    Rows are laid out by range, so a group that holds most rows is several pieces; the
    rows of a piece are numbered, and the sizes of the pieces before it (a handful of rows
    per group) are added. How many pieces there are cannot show in the result.
    """
    ranged = df.repartitionByRange(group, key).withColumn("piece", F.spark_partition_id())
    pieces = write_and_read(ranged, "pieces")
    inside = Window.partitionBy(group, "piece").orderBy(key)
    ahead = Window.partitionBy(group).orderBy("piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = (
        pieces.groupBy(group, "piece")
        .agg(F.count("*").alias("n"))
        .select(
            group,
            "piece",
            F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"),
            F.sum("n").over(Window.partitionBy(group)).alias("group_size"),
        )
    )
    return (
        pieces.withColumn("place", F.row_number().over(inside))
        .join(sizes, [group, "piece"])
        .withColumn("slot", F.col("offset") + F.col("place") - 1)
        .drop("piece", "place", "offset")
    )


def draws(choices: Column, per_employee: int) -> Column:
    """Numbers 0, 1, 2 … of an employee's draws, never more than there are choices."""
    last = F.least(F.lit(per_employee).cast("long"), choices) - 1
    return F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last))


# Skill level and certification by salary.
SKILL_STEPS = [(150_000, "expert"), (100_000, "advanced"), (70_000, "intermediate")]
CERTIFIED_FROM = 100_000


def assign_skills(
    employees: DataFrame,
    departments: DataFrame,
    skills: DataFrame,
    employee_skills: DataFrame,
    categories: Sequence[str],
    department_parts: Sequence[str],
    per_employee: int = 1,
) -> DataFrame:
    """New skill rows: matching departments' staff draw skills of the categories.

    The draw is a function of the keys: the skills are numbered and an employee
    takes ``per_employee`` of them, all if there are no more, from the number the
    own key points at. Skills held already are left out.
    """
    named = F.lit(False)
    for part in department_parts:
        named = named | F.col("department_name").contains(part)
    chosen = departments.filter(named).select("department_id")
    offered = skills.filter(F.col("category").isin(list(categories))).select(
        "skill_id", F.lit("offered").alias("pool")
    )
    numbered = numbered_in_group(offered, "pool", "skill_id")
    slots = write_and_read(numbered.select("skill_id", "slot"), "slots")
    choices = offered.agg(F.count("*")).scalar()
    drawn = (
        employees.select("employee_id", "salary", "department_id")
        .join(chosen, "department_id", "left_semi")
        .withColumn("choices", choices)
        .withColumn("draw", F.explode(draws(F.col("choices"), per_employee)))
        .withColumn("slot", F.pmod(F.col("employee_id") + F.col("draw"), F.col("choices")))
    )
    held = employee_skills.select("employee_id", "skill_id")
    return (
        drawn.join(slots, "slot")
        .join(held, ["employee_id", "skill_id"], "left_anti")
        .select(
            "employee_id",
            "skill_id",
            by_salary(SKILL_STEPS, "beginner").alias("proficiency_level"),
            (F.col("salary") >= CERTIFIED_FROM).alias("certified"),
        )
    )


# Role in a project by salary.
ROLE_STEPS = [(150_000, labels.ROLE_LEADING), (100_000, labels.ROLE_SENIOR)]


def assign_projects(
    employees: DataFrame,
    projects: DataFrame,
    employee_projects: DataFrame,
    percentage: Column,
    starts: Column,
    per_employee: int = 1,
) -> DataFrame:
    """New assignments: everyone draws projects of the own department.

    ``percentage`` and ``starts`` say how much of whose time, and from when, over
    ``employee_id``, ``project_id``, ``salary`` and the project's ``start_date``.

    The draw is a function of the keys: projects of a department are numbered
    and an employee takes ``per_employee`` of them, all if there are no more, from
    the number the own key points at. Work grows with the employees, not with the pairs a department
    could form. Assignments that exist already are left out.
    """
    numbered = numbered_in_group(
        projects.select("project_id", "department_id", "start_date", "project_manager_id"),
        "department_id",
        "project_id",
    )
    slots = write_and_read(numbered.drop("group_size"), "slots")
    sizes = write_and_read(
        projects.groupBy("department_id").agg(F.count("*").alias("choices")), "choices"
    )
    drawn = (
        employees.select("employee_id", "salary", "department_id")
        .join(sizes, "department_id")
        .withColumn("draw", F.explode(draws(F.col("choices"), per_employee)))
        .withColumn("slot", F.pmod(F.col("employee_id") + F.col("draw"), F.col("choices")))
    )
    return (
        drawn.join(slots, ["department_id", "slot"])
        .join(
            employee_projects.select("employee_id", "project_id"),
            ["employee_id", "project_id"],
            "left_anti",
        )
        .select(
            "employee_id",
            "project_id",
            F.when(F.col("employee_id") == F.col("project_manager_id"), labels.ROLE_HEAD)
            .otherwise(by_salary(ROLE_STEPS, labels.ROLE_OTHER))
            .alias("role_in_project"),
            percentage.cast("int").alias("participation_percentage"),
            starts.alias("start_date"),
        )
    )
