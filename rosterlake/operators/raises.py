"""A department-wide raise as one job, all or nothing."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import payroll
from ..sources.scratch import write_and_read
from . import changes


class Raise(NamedTuple):
    """What a raise leads to; all but ``refused`` are as before where it is refused."""

    employees: DataFrame
    refused: DataFrame
    audit: DataFrame
    history: DataFrame
    stats: DataFrame


def raise_department(
    employees: DataFrame,
    departments: DataFrame,
    department_id: int,
    percentage: Decimal,
    at: datetime,
    changed_by: int = changes.SYSTEM_USER,
) -> Raise:
    """Raise the active staff of a department, unless that breaks its budget limit.

    One person above the limit refuses the raise for all: ``refused`` then lists the
    staff with fund and limit, and nothing is changed. Otherwise the new rows carry the time,
    and audit, salary history (with the raise as its reason) and the department's figures
    follow from the same pair of old and new rows.
    """
    raised, _ = payroll.raise_salaries(employees, department_id, percentage, ordered=False)
    here = F.col("department_id") == department_id
    old, new = employees.filter(here), raised.filter(here)
    over = changes.budget_violations(new.filter("is_active"), departments.filter(here))
    refused = write_and_read(over, "refused")
    allowed = refused.isEmpty()
    after = changes.touch(employees, raised, F.lit(at)) if allowed else employees
    now = after.filter(here)
    as_of: date = at.date()
    history, _ = changes.salary_changes(
        old, now, as_of, payroll.raise_reason(department_id, percentage), changed_by
    )
    return Raise(
        after,
        refused,
        changes.audit_diff(old, now, at, changed_by),
        history,
        changes.department_stats_after(old, now),
    )
