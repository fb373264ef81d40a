"""Patches to employees that keep the rules of the table."""

from __future__ import annotations

from datetime import date
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import write_and_read
from . import changes, guards, quality
from .guards import join_by_key


class Patched(NamedTuple):
    employees: DataFrame
    refused: DataFrame
    unknown: DataFrame


def apply_checked_updates(
    employees: DataFrame,
    patches: DataFrame,
    departments: DataFrame,
    positions: DataFrame,
    as_of: date,
) -> Patched:
    """Patches as :func:`changes.apply_updates` reads them, refused where a rule would break.

    ``refused`` names, for each employee whose row would break one, the rules: a check,
    a missing value, a text too long, a reference that leads nowhere, an address that
    someone else keeps or asks for too, a reporting loop, payroll over budget. Those rows
    stay as they were, and so keep an address, a line, a salary that others may then clash with;
    so the last three rules are applied, in this order, until they refuse nobody more.

    Lines and budgets are judged in the order of ``employee_id``. Room that a patch frees in a
    budget is there for the next batch.
    """
    updated, unknown = changes.apply_updates(employees, patches)
    asked = patches.select("employee_id").distinct()
    new = write_and_read(join_by_key(updated, asked, "employee_id", "left_semi"), "patched")
    broken = quality.check_violations("employees", new, as_of).select(
        "employee_id", F.explode("broken").alias("rule")
    )
    parents = {
        "department_id": (departments, "department_id"),
        "position_id": (positions, "position_id"),
        "manager_id": (employees, "employee_id"),
    }
    for column, (parent, key) in parents.items():
        # Departments and positions are few; managers are as many as the rows.
        parent = parent.hint("merge") if parent is employees else parent
        lost = quality.orphan_rows(new, column, parent, key)
        broken = broken.unionByName(
            lost.select("employee_id", F.lit(f"foreign key {column}").alias("rule"))
        )
    old = write_and_read(
        join_by_key(employees, asked, "employee_id", "left_semi").select(
            "employee_id",
            F.struct("email", "manager_id", "salary", "department_id", "is_active").alias("old"),
        ),
        "before_patch",
    )
    refused = write_and_read(broken.distinct(), "broken_rules")
    both = join_by_key(new, old, "employee_id")
    wishes = both.filter("email IS NOT NULL AND NOT email <=> old.email").select("employee_id", "email")
    # Two who ask for one address both go without; so do those refused for other reasons.
    open_ = join_by_key(wishes, refused, "employee_id", "left_anti")
    alone = open_.groupBy("email").agg(F.count("*").alias("n")).filter("n > 1").select("email")
    shared = join_by_key(open_, alone, "email").select("employee_id", F.lit("unique email").alias("rule"))
    refused = write_and_read(refused.unionByName(shared), "broken_rules")
    wishes = write_and_read(join_by_key(open_, alone, "email", "left_anti"), "wishes")
    lines = both.filter("NOT manager_id <=> old.manager_id").select(
        "employee_id", F.col("employee_id").alias("turn"), "manager_id"
    )
    lines = write_and_read(lines, "new_lines")
    stays = F.col("old.is_active") & F.col("old.department_id").eqNullSafe(F.col("department_id"))
    need = guards.thousandths(F.col("salary")) - F.when(stays, guards.thousandths(F.col("old.salary"))).otherwise(0)
    pay = both.filter("NOT salary <=> old.salary OR NOT department_id <=> old.department_id").select(
        F.col("employee_id").alias("no"), "department_id", need.alias("need"),
        F.when(F.col("is_active"), F.greatest(need, F.lit(0))).otherwise(0).alias("take"),
    )
    pay = write_and_read(pay, "new_pay")
    room = write_and_read(guards.payroll_room(departments, employees), "room")
    edges, owners = employees.select("employee_id", "manager_id"), employees.select("employee_id", "email")
    def named(rows: DataFrame, rule: str) -> DataFrame:
        return rows.select(rows.columns[0], F.lit(rule).alias("rule")).toDF("employee_id", "rule")

    first, moved = True, True
    while first or not more.isEmpty():
        gone = refused.select("employee_id")
        more = named(guards.refused_addresses(wishes, owners, gone.distinct()), "unique email")
        more = write_and_read(more, "more")
        gone = gone.unionByName(more.select("employee_id"))
        if first or not join_by_key(more, lines, "employee_id", "left_semi").isEmpty() or moved:
            loops = guards.refused_loops(edges, join_by_key(lines, gone, "employee_id", "left_anti"))
            more = write_and_read(more.unionByName(named(loops, "reporting loop")), "more")
            gone = refused.select("employee_id").unionByName(more.select("employee_id"))
        if first:  # later there are fewer requests, so who fits once still does
            asking = join_by_key(pay, gone.withColumnRenamed("employee_id", "no"), "no", "left_anti")
            over = guards.refused_by_budget(asking, room)
            over = named(over, "payroll over budget")
            moved = not join_by_key(over, lines, "employee_id", "left_semi").isEmpty()
            more = more.unionByName(over)
        else:
            moved = False
        first, more = False, write_and_read(more, "more")
        refused = write_and_read(refused.unionByName(more), "broken_rules")
    refused = refused.groupBy("employee_id").agg(F.sort_array(F.collect_set("rule")).alias("broken"))
    refused = write_and_read(refused, "refused")
    good = join_by_key(new, refused.select("employee_id"), "employee_id", "left_anti")
    rest = join_by_key(employees, good.select("employee_id"), "employee_id", "left_anti")
    return Patched(rest.unionByName(good.select(*employees.columns)), refused, unknown)
