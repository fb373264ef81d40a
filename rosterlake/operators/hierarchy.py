"""Reporting lines: the whole tree, one manager's people, and loops.

Lines are resolved by jumping, safe on loops and without a depth limit. Every row keeps a
pointer to its farthest known superior and the path from there; each round a row takes over
the pointer of the row it points to, so a line of n levels takes log2(n) rounds instead of
n. One manager's people are the rows whose line ends at that manager.

Each round is written out, which keeps plans short, survives lost executors and
lets the planner choose the join from the true size of what was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import labels
from ..functions.expressions import arranged, asc, full_name
from ..sources.scratch import write_and_read


def _resolve(start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Follow pointers until every line ends; returns (resolved, looping).

    ``start`` holds ``employee_id``, ``top`` (superior, NULL at a root),
    ``level`` and, where wanted, ``path``. Rows whose line runs into a superior that is not in
    ``start`` are dropped. Rows on or under a loop never end and are returned
    apart: a round that neither resolves nor drops a row proves that only such
    rows are left.
    """
    superiors = start.select(F.col("top").alias("employee_id")).where("employee_id IS NOT NULL")
    marked = start.join(
        superiors.distinct().withColumn("leads", F.lit(True)), "employee_id", "left"
    )
    state = write_and_read(marked, "lines")
    carried = [c for c in ("level", "path") if c in start.columns]
    grown = {
        "level": F.col("level") + F.col("step_level"),
        "path": F.concat("step_path", F.lit(labels.PATH_SEPARATOR), "path"),
    }
    resolved = state.filter("top IS NULL")
    pending = state.filter("top IS NOT NULL")
    left = pending.count()
    while left:
        known = resolved.unionByName(pending).filter("leads")
        step = known.select(
            F.col("employee_id").alias("top"),
            F.col("top").alias("next_top"),
            *[F.col(c).alias(f"step_{c}") for c in carried],
        )
        jumped = write_and_read(
            pending.join(step, "top").select(
                "employee_id",
                F.col("next_top").alias("top"),
                *[grown[c].alias(c) for c in carried],
                "leads",
            ),
            "lines",
        )
        resolved = resolved.unionByName(jumped.filter("top IS NULL"))
        pending = jumped.filter("top IS NOT NULL")
        before, left = left, pending.count()
        if left == before:
            break
    return resolved.drop("top", "leads"), pending


def employee_hierarchy(
    employees: DataFrame, departments: DataFrame, positions: DataFrame, ordered: bool = True
) -> DataFrame:
    """The tree of active employees below the active employees without manager.

    An inactive manager cuts off everyone below.
    """
    active = employees.filter("is_active")
    lines, _ = _resolve(
        active.select(
            "employee_id",
            F.col("manager_id").alias("top"),
            F.lit(1).alias("level"),
            full_name().alias("path"),
        )
    )
    managers = employees.select(
        F.col("employee_id").alias("manager_id"), full_name().alias("manager_name")
    )
    tree = (
        active.select(
            "employee_id", "first_name", "last_name", "position_id", "department_id", "manager_id"
        )
        .join(lines, "employee_id")
        .join(positions.select("position_id", "position_title"), "position_id", "left")
        .join(departments.select("department_id", "department_name"), "department_id", "left")
        .join(managers, "manager_id", "left")
        .select(
            "employee_id",
            "first_name",
            "last_name",
            "position_title",
            "department_name",
            "manager_id",
            "manager_name",
            "level",
            F.col("path").alias("reporting_path"),
            F.concat(
                F.repeat(F.lit(labels.INDENT), F.col("level") - 1), full_name()
            ).alias("indented_name"),
        )
    )
    return arranged(tree, ordered, asc("reporting_path"), asc("employee_id"))


def _below(edges: DataFrame, manager_id: int, *carried: Column) -> DataFrame:
    """Everyone of ``edges(employee_id, manager_id, …)`` whose line leads to a manager, with the level.

    The manager is where lines end, so direct reports are the roots, and whoever's line
    ends elsewhere, or never, is left out.
    """
    start = edges.filter(F.col("manager_id").isNotNull() & (F.col("employee_id") != manager_id))
    reached, _ = _resolve(
        start.select(
            "employee_id",
            F.when(F.col("manager_id") != manager_id, F.col("manager_id")).alias("top"),
            F.lit(1).alias("level"),
            *carried,
        )
    )
    return reached


def subordinates(employees: DataFrame, manager_id: int, ordered: bool = True) -> DataFrame:
    """Everyone below a manager, inactive staff included, with the level."""
    reached = _below(employees.select("employee_id", "manager_id"), manager_id)
    return arranged(
        employees.join(reached, "employee_id"),
        ordered,
        asc("level"),
        asc("last_name"),
        asc("first_name"),
        asc("employee_id"),
    )


def manager_subordinates(
    employees: DataFrame, positions: DataFrame, manager_id: int, ordered: bool = True
) -> DataFrame:
    """Active direct and indirect reports with position, level and path."""
    placed = employees.filter("is_active").join(positions.select("position_id"), "position_id", "left_semi")
    reached = _below(placed, manager_id, full_name().alias("path"))
    shown = (
        placed.select("employee_id", "position_id", full_name().alias("name"))
        .join(reached, "employee_id")
        .join(positions.select("position_id", "position_title"), "position_id")
    )
    return arranged(
        shown.select(
            F.col("employee_id").alias("subordinate_id"),
            F.col("name").alias("subordinate_name"),
            F.col("position_title").alias("subordinate_position"),
            F.col("level").alias("hierarchy_level"),
            F.col("path").alias("reporting_path"),
        ),
        ordered,
        asc("hierarchy_level"),
        asc("subordinate_name"),
        asc("subordinate_id"),
    )


def hierarchy_violations(employees: DataFrame) -> DataFrame:
    """Employees who manage themselves or sit on a reporting loop.

    The rows that never end are on a loop or below one. Following a loop moves
    its rows among themselves, while rows below it end up on it, so the set of
    pointers shrinks, round by round, to exactly the rows on loops.
    """
    edges = employees.select("employee_id", "manager_id")
    itself = edges.filter("manager_id = employee_id").select(
        "employee_id", F.lit("self_manager").alias("violation")
    )
    _, looping = _resolve(
        edges.select(
            "employee_id",
            F.expr("nullif(manager_id, employee_id)").alias("top"),
        )
    )
    ahead = looping.select("employee_id", "top")
    reached = ahead.select("top").distinct().count()
    while reached:
        ahead = write_and_read(
            ahead.join(
                ahead.select(F.col("employee_id").alias("top"), F.col("top").alias("next_top")),
                "top",
            ).select("employee_id", F.col("next_top").alias("top")),
            "loops",
        )
        before, reached = reached, ahead.select("top").distinct().count()
        if reached == before:
            break
    loops = ahead.select(
        F.col("top").alias("employee_id"), F.lit("cycle").alias("violation")
    ).distinct()
    return itself.unionByName(loops)
