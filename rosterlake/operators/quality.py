"""Data-quality jobs: the rules the tables and requests promise to keep."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..sources.tables import SCHEMAS

# Fixed value: what an address looks like; letter case does not matter.
EMAIL_PATTERN = r"(?i)^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"

# One condition per rule; a rule whose condition is NULL holds.
CHECKS: dict[str, dict[str, str]] = {
    "departments": {"budget_positive": "budget >= 0"},
    "positions": {
        "salary_range": "base_salary_max >= base_salary_min",
        "level_value": """position_level IN ('trainee', 'junior', 'middle', 'senior', 'lead',
                          'manager', 'director', 'executive')""",
    },
    "employees": {
        "email_format": f"email RLIKE r'{EMAIL_PATTERN}'",
        "salary_positive": "salary >= 0",
        "hire_date": "hire_date <= DATE'{as_of}'",
        "birth_date": "birth_date <= add_months(DATE'{as_of}', -12 * 18)",
    },
    "projects": {
        "budget_positive": "budget >= 0",
        "dates": "end_date >= start_date",
        "status_value": """status IN ('planning', 'active', 'on_hold', 'completed',
                           'cancelled')""",
    },
    "employee_projects": {
        "percentage": "participation_percentage BETWEEN 0 AND 100",
        "hourly_rate": "hourly_rate >= 0",
        "dates_project": "end_date >= start_date",
    },
    "salary_history": {
        "salary_increase": "new_salary >= old_salary",
        "change_date": "change_date <= DATE'{as_of}'",
    },
    "vacations": {
        "dates_vacation": "end_date >= start_date",
        "vacation_type": "vacation_type IN ('annual', 'sick', 'maternity', 'unpaid', 'other')",
        "status": "status IN ('requested', 'approved', 'rejected', 'taken', 'cancelled')",
    },
    "employee_skills": {
        "proficiency_level": """proficiency_level IN ('beginner', 'intermediate', 'advanced',
                                'expert')""",
        "certification_date": "certification_date <= DATE'{as_of}'",
    },
    "audit_log": {"operation_type": "operation_type IN ('INSERT', 'UPDATE', 'DELETE')"},
}

# Keys that may occur once.
UNIQUE_KEYS: list[tuple[str, tuple[str, ...]]] = [
    ("departments", ("department_name",)),
    ("positions", ("position_title",)),
    ("employees", ("email",)),
    ("skills", ("skill_name",)),
    ("employee_skills", ("employee_id", "skill_id")),
]

# The primary key of every table.
PRIMARY_KEYS: dict[str, str] = {
    "departments": "department_id",
    "positions": "position_id",
    "employees": "employee_id",
    "projects": "project_id",
    "employee_projects": "employee_project_id",
    "salary_history": "salary_change_id",
    "vacations": "vacation_id",
    "skills": "skill_id",
    "employee_skills": "employee_skill_id",
    "audit_log": "log_id",
}

# The longest text a column takes.
LENGTHS: dict[str, dict[str, int]] = {
    "departments": {"department_name": 255, "location": 255},
    "positions": {"position_title": 255, "position_level": 50},
    "employees": {"first_name": 100, "last_name": 100, "email": 255, "phone": 20},
    "projects": {"project_name": 255, "status": 50},
    "employee_projects": {"role_in_project": 100},
    "salary_history": {"change_reason": 255},
    "vacations": {"vacation_type": 50, "status": 50},
    "skills": {"skill_name": 255, "category": 100},
    "employee_skills": {"proficiency_level": 50},
    "audit_log": {"table_name": 100, "operation_type": 10},
}

# Table, column, and the table and key it refers to.
REFERENCES: list[tuple[str, str, str, str]] = [
    ("employees", "department_id", "departments", "department_id"),
    ("employees", "position_id", "positions", "position_id"),
    ("employees", "manager_id", "employees", "employee_id"),
    ("projects", "department_id", "departments", "department_id"),
    ("projects", "project_manager_id", "employees", "employee_id"),
    ("employee_projects", "employee_id", "employees", "employee_id"),
    ("employee_projects", "project_id", "projects", "project_id"),
    ("salary_history", "employee_id", "employees", "employee_id"),
    ("salary_history", "changed_by", "employees", "employee_id"),
    ("vacations", "employee_id", "employees", "employee_id"),
    ("vacations", "approved_by", "employees", "employee_id"),
    ("employee_skills", "employee_id", "employees", "employee_id"),
    ("employee_skills", "skill_id", "skills", "skill_id"),
    ("audit_log", "changed_by", "employees", "employee_id"),
]

# Promised in the data model but never enforced there: keys unique among some rows.
PARTIAL_UNIQUE_KEYS: list[tuple[str, tuple[str, ...], str]] = [
    ("employees", ("phone",), "phone IS NOT NULL"),
    ("employee_projects", ("employee_id", "project_id"), "end_date IS NULL"),
]

# What a request must satisfy, stricter than the tables.
REQUEST_RULES: dict[str, dict[str, str]] = {
    "employee": {
        "first_name_length": "coalesce(length(first_name) BETWEEN 1 AND 100, false)",
        "last_name_length": "coalesce(length(last_name) BETWEEN 1 AND 100, false)",
        "email_format": f"coalesce(email RLIKE r'{EMAIL_PATTERN}', false)",
        "phone_length": "length(phone) <= 20",
        "hire_date": "coalesce(hire_date <= DATE'{as_of}', false)",
        "salary": "coalesce(salary > 0, false)",
    },
    "department": {
        "name_length": "coalesce(length(department_name) BETWEEN 1 AND 150, false)",
        "budget": "budget >= 0",
    },
    "position": {
        "title_length": "coalesce(length(position_title) BETWEEN 1 AND 150, false)",
        "lowest": "base_salary_min >= 0",
        "highest": "base_salary_max >= 0",
        "range": """base_salary_max >= base_salary_min OR base_salary_max = 0
                    OR base_salary_min = 0""",
    },
    "project": {
        "name_length": "coalesce(length(project_name) BETWEEN 1 AND 200, false)",
        "budget": "budget >= 0",
        "dates": "end_date >= start_date",
    },
    "vacation": {
        "employee": "employee_id IS NOT NULL",
        "dates": "coalesce(end_date >= start_date, false)",
    },
    "salary_change": {
        "employee": "employee_id IS NOT NULL",
        "new_salary": "coalesce(new_salary > 0, false)",
    },
    "raise": {"percent": "coalesce(percent > 0 AND percent <= 100, false)"},
}


def _broken(condition: str, as_of: date) -> Column:
    return ~F.expr(condition.replace("{as_of}", as_of.isoformat()))


def required_columns(table: str) -> list[str]:
    """Columns of a table that may not be NULL."""
    return re.findall(r"(\w+) \S+ NOT NULL", SCHEMAS[table])


def _row_rules(table: str, df: DataFrame, as_of: date) -> dict[str, Column]:
    """Every rule of a table that looks at one row, as "is broken"."""
    rules = {f"check {n}": _broken(c, as_of) for n, c in CHECKS.get(table, {}).items()}
    for column in required_columns(table):
        rules[f"not null {column}"] = F.col(column).isNull()
    for column, most in LENGTHS.get(table, {}).items():
        rules[f"length {column}"] = F.length(column) > most
    return rules


def _complete(table: str, df: DataFrame) -> DataFrame:
    """``df`` with the columns it lacks as NULLs: a required one is then missing in every row."""
    fields = StructType.fromDDL(SCHEMAS[table].replace("NOT NULL", "")).fields
    absent = [f for f in fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in absent])


def check_report(table: str, df: DataFrame, as_of: date) -> DataFrame:
    """Violations of the checks and NOT NULLs of one table, in one scan."""
    df = _complete(table, df)
    rules = _row_rules(table, df, as_of)
    counted = df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(table).alias("table_name"),
                        F.lit(n).alias("constraint_name"),
                        F.col(f"`{n}`").alias("violations"),
                    )
                    for n in rules
                ]
            )
        )
    )


def check_violations(table: str, df: DataFrame, as_of: date) -> DataFrame:
    """The rows that break a row rule, with the names of the rules."""
    rules = _row_rules(table, df, as_of)
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return _complete(table, df).withColumn("broken", names).select(*df.columns, "broken").filter(F.size("broken") > 0)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held more than once, and how often; NULL keys never clash."""
    held = df
    for column in key:
        held = held.filter(F.col(column).isNotNull())
    return held.groupBy(*key).agg(F.count("*").alias("held")).filter("held > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Values of a reference that lead nowhere, and how many rows hold each.

    The child is reduced to its distinct values first, so a value that a third of
    the rows share costs one row in the join.
    """
    values = (
        child.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias(key))
        .agg(F.count("*").alias("held"))
    )
    return values.join(parent.select(key), key, "left_anti").withColumnRenamed(key, column)


def orphan_rows(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """The rows behind :func:`orphans`."""
    keys = parent.select(F.col(key).alias(column))
    return child.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


def _key_fields(df: DataFrame, key: Sequence[str], texts: int, wholes: int) -> list[Column]:
    """The columns of a key in typed places: texts apart from whole numbers."""
    named = [c for c in key if isinstance(df.schema[c].dataType, StringType)]
    numbered = [c for c in key if c not in named]
    fields = []
    for kind, columns, width in (("string", named, texts), ("long", numbered, wholes)):
        for place in range(width):
            value = F.col(columns[place]) if place < len(columns) else F.lit(None)
            fields.append(value.cast(kind).alias(f"{kind}_{place}"))
    return fields


def _keys_of(table: str) -> list[tuple[str, tuple[str, ...], str]]:
    """Name, columns and condition of what may occur once in a table."""
    keys = [(f"primary key {PRIMARY_KEYS[table]}", (PRIMARY_KEYS[table],), "true")]
    keys += [(f"unique {', '.join(k)}", k, "true") for t, k in UNIQUE_KEYS if t == table]
    return keys + [(f"unique {', '.join(k)} where {c}", k, c) for t, k, c in PARTIAL_UNIQUE_KEYS if t == table]


def constraint_report(tables: dict[str, DataFrame], as_of: date) -> DataFrame:
    """Violations per table and constraint; every table is read once.

    One select per table emits tagged rows for the rules a row breaks, the keys it holds, the
    references it makes and the key others refer to. They are counted per line of the report and value, with nothing
    but the count beside them: a broken rule is one row per task, a key held more than once a
    violation. Of references that leaves their distinct values, which then meet the keys they refer to.
    """
    tables = {t: _complete(t, df) for t, df in tables.items() if t in SCHEMAS}
    keys = [(t, k) for t in tables for _, k, _ in _keys_of(t)]
    named = [sum(isinstance(tables[t].schema[c].dataType, StringType) for c in k) for t, k in keys]
    texts, wholes = max(named), max(len(k) - n for (_, k), n in zip(keys, named, strict=True))
    parents = {parent: key for _, _, parent, key in REFERENCES if parent in tables}
    numbers = {parent: number for number, parent in enumerate(parents)}
    lines: list[tuple[str, str]] = []
    single: list[int] = []
    references: dict[int, int] = {}
    tagged = None

    def number_of(table: str, name: str) -> int:
        lines.append((table, name))
        return len(lines) - 1

    def tag(line: int, fields: Sequence[Column]) -> Column:
        return F.struct(F.lit(line).alias("line"), *fields)

    for table, df in tables.items():
        no_key = _key_fields(df, (), texts, wholes)
        entries = []
        for name, broken in _row_rules(table, df, as_of).items():
            entries.append(F.when(broken, tag(number_of(table, name), no_key)))
        for name, key, condition in _keys_of(table):
            line = number_of(table, name)
            single.append(line)
            present = F.expr(condition)
            for column in key:
                present = present & F.col(column).isNotNull()
            entries.append(F.when(present, tag(line, _key_fields(df, key, texts, wholes))))
        for owner, column, parent, _ in REFERENCES:
            if owner == table and parent in parents:
                line = number_of(table, f"foreign key {column}")
                references[line] = numbers[parent]
                fields = _key_fields(df, (column,), texts, wholes)
                entries.append(F.when(F.col(column).isNotNull(), tag(line, fields)))
        if table in parents:
            # What is referred to has the lines below zero.
            entries.append(tag(-1 - numbers[table], _key_fields(df, (parents[table],), texts, wholes)))
        rows = df.select(F.inline(F.array_compact(F.array(*entries))))
        tagged = rows if tagged is None else tagged.unionByName(rows)

    key = [f"string_{place}" for place in range(texts)] + [f"long_{place}" for place in range(wholes)]
    held = tagged.groupBy("line", *key).agg(F.count("*").alias("held"))
    # References and what they refer to meet under the parent's line; all else is settled and needs no key.
    meets = F.col("line") < 0
    place = F.col("line")
    for parent in numbers.values():
        own = [line for line, number in references.items() if number == parent]
        meets = meets | F.col("line").isin(own)
        place = F.when(F.col("line").isin(own), -1 - parent).otherwise(place)
    violations = F.when(F.col("line").isin(single), F.lit(1).cast("long")).otherwise(F.col("held"))
    counted = (
        held.filter(~F.col("line").isin(single) | (F.col("held") > 1))
        .select("line", violations.alias("held"), place.alias("place"), *[F.when(meets, F.col(c)).alias(c) for c in key])
        .groupBy("place", *key)
        .agg(
            F.sum("held").alias("held"),
            F.bool_or(F.col("line") < 0).alias("known"),
            *[F.sum(F.when(F.col("line") == line, F.col("held"))).alias(f"line_{line}") for line in references],
        )
    )

    def entry(line: Column, count: Column) -> Column:
        return F.struct(line.alias("line"), count.alias("violations"))

    found = F.when(F.col("place") >= 0, F.array(entry(F.col("place"), F.col("held"))))
    if references:
        lost = F.array(*[entry(F.lit(line), F.col(f"line_{line}")) for line in references])
        found = found.when(~F.col("known"), lost)
    counted = counted.select(F.inline(found)).groupBy("line").agg(F.sum("violations").alias("violations"))
    names = tagged.sparkSession.createDataFrame(
        [(number, table, name) for number, (table, name) in enumerate(lines)],
        "line INT, table_name STRING, constraint_name STRING",
    )
    return names.join(counted, "line", "left").select(
        "table_name",
        "constraint_name",
        F.coalesce("violations", F.lit(0)).cast("long").alias("violations"),
    )


def request_errors(kind: str, requests: DataFrame, as_of: date) -> DataFrame:
    """Requests with the names of the rules they break, in ``errors``."""
    rules = {n: _broken(c, as_of) for n, c in REQUEST_RULES[kind].items()}
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return requests.withColumn("errors", names)
