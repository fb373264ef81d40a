"""What follows from changed rows: audit, history, heads, status, budgets."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import moment
from ..functions.payroll import FUND_LIMIT, budget_room
from ..sources.scratch import write_and_read
from ..sources.tables import json_record
from .snapshots import differing

# The columns an audit row shows, defaults for who and why.
AUDITED = [
    "first_name",
    "last_name",
    "email",
    "salary",
    "department_id",
    "position_id",
    "manager_id",
]
SYSTEM_USER = 1
DEFAULT_REASON = "salary_adjustment"

# Levels that make their holder head of the department.
HEAD_LEVELS = ["manager", "director", "executive"]

# Fixed value: the longest leave in days.
LONGEST_LEAVE = 60


def _pair(
    before: DataFrame, after: DataFrame, how: str, columns: list[str], few_changes: bool = False
) -> DataFrame:
    """Rows of two snapshots side by side as ``old`` and ``new`` structs.

    With ``few_changes`` digests tell first where the two differ, and only rows from there are paired:
    more reading, far less shuffling if most rows are as they were.
    """
    if few_changes:
        before, after = differing(before, after, "employee_id", columns)
    old = before.select("employee_id", F.struct(*columns).alias("old"))
    new = after.select("employee_id", F.struct(*columns).alias("new"))
    return old.join(new, "employee_id", how)


def _shared(before: DataFrame, after: DataFrame) -> list[str]:
    return [c for c in after.columns if c in before.columns and c != "employee_id"]


def _differs(left: str, right: str) -> Column:
    return ~F.col(left).eqNullSafe(F.col(right))


def audit_diff(
    before: DataFrame,
    after: DataFrame,
    at: datetime,
    changed_by: int = SYSTEM_USER,
    few_changes: bool = False,
) -> DataFrame:
    """Audit rows for what was inserted, changed or deleted between two snapshots."""
    paired = _pair(before, after, "full_outer", _shared(before, after), few_changes).filter(
        _differs("old", "new")
    )

    def shown(side: str) -> Column:
        record = json_record(*[F.col(f"{side}.{c}").alias(c) for c in AUDITED])
        return F.when(F.col(side).isNotNull(), record)

    return paired.select(
        F.lit("employees").alias("table_name"),
        F.col("employee_id").alias("record_id"),
        F.when(F.col("old").isNull(), "INSERT")
        .when(F.col("new").isNull(), "DELETE")
        .otherwise("UPDATE")
        .alias("operation_type"),
        shown("old").alias("old_values"),
        shown("new").alias("new_values"),
        F.lit(changed_by).cast("long").alias("changed_by"),
        moment(at).alias("changed_at"),
    )


def salary_changes(
    before: DataFrame,
    after: DataFrame,
    as_of: date,
    reason: str = DEFAULT_REASON,
    changed_by: int = SYSTEM_USER,
    few_changes: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Salary history rows for changed salaries; decreases come back apart."""
    changed = (
        _pair(before, after, "inner", ["salary"], few_changes)
        .filter(_differs("old.salary", "new.salary"))
        .select(
            "employee_id",
            F.coalesce("old.salary", F.lit(0)).cast("decimal(12,2)").alias("old_salary"),
            F.col("new.salary").alias("new_salary"),
            F.lit(as_of).alias("change_date"),
            F.lit(reason).alias("change_reason"),
            F.lit(changed_by).cast("long").alias("changed_by"),
        )
    )
    rises = F.col("new_salary") >= F.col("old_salary")
    return changed.filter(rises), changed.filter(~F.coalesce(rises, F.lit(False)))


def touch(
    before: DataFrame, after: DataFrame, at: Column, key: str = "employee_id", few_changes: bool = False
) -> DataFrame:
    """``after`` with ``updated_at`` set to ``at`` on the rows that changed."""
    columns = [c for c in after.columns if c in before.columns and c not in (key, "updated_at")]
    if few_changes:
        was, now = differing(before, after, key, columns)
        both = was.select(key, F.struct(*columns).alias("old")).join(
            now.select(key, F.struct(*columns).alias("new")), key
        )
        changed = write_and_read(both.filter(_differs("old", "new")).select(key, F.lit(True).alias("changed")), "touched")
        return after.join(changed, key, "left").select(
            *[F.col(c) for c in after.columns if c != "updated_at"],
            F.when(F.col("changed"), at).otherwise(F.col("updated_at")).alias("updated_at"),
        )
    old = before.select(key, F.struct(*columns).alias("old"), F.lit(True).alias("was_there"))
    changed = F.coalesce("was_there", F.lit(False)) & ~F.col("old").eqNullSafe(
        F.struct(*columns)
    )
    return after.join(old, key, "left").select(
        *[F.col(c) for c in after.columns if c != "updated_at"],
        F.when(changed, at).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def reassign_department_heads(
    before: DataFrame,
    after: DataFrame,
    positions: DataFrame,
    departments: DataFrame,
    changed: str = "changed_on",
    at: Column | None = None,
) -> DataFrame:
    """Departments headed by whoever last moved into a leading position there.

    With ``at``, departments that get a new head have it as ``updated_at``.

    ``changed`` names the column of ``after`` that orders the moves. A new
    employee counts as a move.
    """
    leading = positions.filter(F.col("position_level").isin(HEAD_LEVELS)).select("position_id")
    old = before.select(
        "employee_id",
        F.col("position_id").alias("old_position"),
        F.col("department_id").alias("old_department"),
    )
    moved = (
        after.select("employee_id", "position_id", "department_id", changed)
        .join(leading, "position_id", "left_semi")
        .join(old, "employee_id", "left")
        .filter(
            _differs("position_id", "old_position") | _differs("department_id", "old_department")
        )
    )
    heads = moved.groupBy("department_id").agg(
        F.max_by("employee_id", F.struct(changed, "employee_id")).alias("new_head")
    )
    new = {"manager_id": F.coalesce("new_head", "manager_id")}
    if at is not None:
        new["updated_at"] = F.when(F.col("new_head").isNotNull(), at).otherwise(F.col("updated_at"))
    return departments.join(heads, "department_id", "left").select(
        *[new.get(c, F.col(c)).alias(c) for c in departments.columns],
        F.col("new_head").isNotNull().alias("reassigned"),
    )


def vacation_days_check(vacations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leave with its length in days; too long leave comes back apart."""
    counted = vacations.withColumn(
        "days_count", F.datediff("end_date", "start_date") + F.lit(1)
    )
    too_long = F.coalesce(F.col("days_count") > LONGEST_LEAVE, F.lit(False))
    return counted.filter(~too_long), counted.filter(too_long)


def project_status(projects: DataFrame, as_of: date) -> DataFrame:
    """Ended projects become completed, begun plans become active."""
    today = F.lit(as_of)
    return projects.withColumn(
        "status",
        F.when(F.col("end_date") < today, "completed")
        .when((F.col("start_date") <= today) & (F.col("status") == "planning"), "active")
        .otherwise(F.col("status")),
    )


def budget_violations(employees: DataFrame, departments: DataFrame) -> DataFrame:
    """Employees whose pay, on top of their active colleagues', breaks the limit.

    The fund is summed once per department; a row that is not active adds its own
    pay to it, an active one is in it already.
    """
    own = F.when(F.coalesce("is_active", F.lit(False)), F.lit(0)).otherwise(F.col("salary"))
    fund = F.coalesce("fund", F.lit(0)) + own
    limit = F.col("budget") * F.lit(FUND_LIMIT)
    return (
        employees.select("employee_id", "department_id", "salary", "is_active")
        .join(budget_room(departments, employees), "department_id")
        .select(
            "employee_id",
            "department_id",
            fund.alias("fund"),
            limit.alias("fund_limit"),
        )
        .filter("fund > fund_limit")
    )


def department_stats_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pay figures of the departments that a change touched."""
    paired = _pair(before, after, "full_outer", ["salary", "department_id"])
    touched = (
        paired.filter(_differs("old", "new"))
        .select(F.explode(F.array("old.department_id", "new.department_id")).alias("department_id"))
        .filter("department_id IS NOT NULL")
        .distinct()
    )
    pay = F.when(F.col("is_active"), F.col("salary"))
    stats = after.groupBy("department_id").agg(
        F.count("*").alias("employees"),
        F.sum(pay).alias("fund"),
        F.count(pay).alias("paid"),
        F.min(pay).alias("min_salary"),
        F.max(pay).alias("max_salary"),
    )
    return touched.join(stats, "department_id", "left").select(
        "department_id",
        F.coalesce("employees", F.lit(0)).cast("long").alias("employees"),
        F.coalesce("fund", F.lit(0)).alias("fund"),
        (F.col("fund") / F.nullif(F.col("paid"), F.lit(0))).alias("avg_salary"),
        "min_salary",
        "max_salary",
    )


def apply_updates(employees: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Employees with patches applied, and the patches for nobody.

    ``patches`` holds ``employee_id``, ``patch_no``, ``fields`` (the names the
    request set) and a column per patched field; a field set later wins, and a
    field may be set to NULL.
    """
    patched = [
        c for c in patches.columns if c in employees.columns and c != "employee_id"
    ]
    latest = patches.groupBy("employee_id").agg(
        *[
            F.max_by(c, F.when(F.array_contains("fields", c), F.col("patch_no"))).alias(f"new_{c}")
            for c in patched
        ],
        *[F.bool_or(F.array_contains("fields", c)).alias(f"set_{c}") for c in patched],
    )
    updated = employees.join(latest, "employee_id", "left").select(
        *[
            F.when(F.col(f"set_{c}"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
            if c in patched
            else F.col(c)
            for c in employees.columns
        ]
    )
    unknown = patches.join(employees.select("employee_id"), "employee_id", "left_anti")
    return updated, unknown


# What a deletion does to each reference to an employee.
RESTRICTING = [("projects", "project_manager_id"), ("salary_history", "changed_by")]
CASCADING = ["employee_projects", "salary_history", "vacations", "employee_skills"]
CLEARING = [
    ("employees", "manager_id"),
    ("vacations", "approved_by"),
    ("audit_log", "changed_by"),
]


def delete_employees(
    ids: DataFrame, tables: dict[str, DataFrame]
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the given employees, and the ids that may not go.

    An employee who manages a project or recorded a raise stays. References are
    reduced to distinct keys before they meet the ids. The ids that go are
    written once, since every table reads them.
    """
    wanted = ids.select("employee_id").distinct()
    blocked = None
    for name, column in RESTRICTING:
        if name in tables:
            holders = wanted.join(
                tables[name].select(F.col(column).alias("employee_id")).distinct(),
                "employee_id",
                "left_semi",
            ).select("employee_id", F.lit(f"{name}.{column}").alias("held_by"))
            blocked = holders if blocked is None else blocked.unionByName(holders)
    gone = wanted
    if blocked is not None:
        blocked = write_and_read(blocked, "blocked")
        gone = wanted.join(blocked, "employee_id", "left_anti")
    gone = write_and_read(gone, "gone")
    left = dict(tables)
    left["employees"] = tables["employees"].join(gone, "employee_id", "left_anti")
    for name in CASCADING:
        if name in tables:
            left[name] = tables[name].join(gone, "employee_id", "left_anti")
    for name, column in CLEARING:
        if name in left:
            cleared = gone.select(
                F.col("employee_id").alias(column), F.lit(True).alias("is_gone")
            )
            order = left[name].columns
            left[name] = (
                left[name]
                .join(cleared, column, "left")
                .withColumn(column, F.when(F.col("is_gone").isNull(), F.col(column)))
                .select(*order)
            )
    return left, blocked
