"""Column expressions shared by the reports."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asc(name: str) -> Column:
    """Ascending with NULL last, as the reports promise."""
    return F.col(name).asc_nulls_last()


def desc(name: str) -> Column:
    """Descending with NULL first, as the reports promise."""
    return F.col(name).desc_nulls_first()


def arranged(df: DataFrame, ordered: bool, *keys: Column) -> DataFrame:
    """Sort for a reader; a job that writes a table can leave the sort out."""
    return df.orderBy(*keys) if ordered else df


def full_name(prefix: str = "") -> Column:
    """First and last name; NULL if either is."""
    return F.concat(F.col(f"{prefix}first_name"), F.lit(" "), F.col(f"{prefix}last_name"))


def people(employees: DataFrame, role: str, *fields: str) -> DataFrame:
    """Employees in another role: the key and fields carry the role as prefix."""
    return employees.select(
        F.col("employee_id").alias(f"{role}_id"),
        *[F.col(f).alias(f"{role}_{f}") for f in fields],
    )


def percent(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole`` with two digits, NULL for a zero whole."""
    return F.round(part * 100 / F.nullif(whole, F.lit(0)), 2)


def completed_years(since: Column, as_of: date) -> Column:
    """Whole calendar years from ``since`` to ``as_of``."""
    before_anniversary = F.date_format(since, "MMdd") > F.lit(f"{as_of:%m%d}")
    return (F.lit(as_of.year) - F.year(since) - before_anniversary.cast("int")).cast("int")


def moment(at: datetime) -> Column:
    """A point in time as the tables hold it, whatever the zone of the session."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def is_open(end_date: Column, as_of: date) -> Column:
    """An assignment without end, or one that has not ended yet."""
    return end_date.isNull() | (end_date >= F.lit(as_of))


def compare(value: Column, other: Column, more: str, less: str, same: str) -> Column:
    return F.when(value > other, more).when(value < other, less).otherwise(same)


def monthly_cost(rate_points: Column, salary_points: Column) -> Column:
    """Monthly cost out of summed ``rate × percent`` and ``salary × percent``.

    A rate is paid for 160 hours a month, a salary is a yearly amount, so both
    sums share the denominator 1200. NULL when there is nothing to add.
    """
    zero = F.lit(0).cast("decimal(30,2)")
    total = F.coalesce(rate_points, zero) * 1920 + F.coalesce(salary_points, zero)
    return F.when(
        rate_points.isNotNull() | salary_points.isNotNull(), total.cast("decimal(30,2)") / 1200
    )
