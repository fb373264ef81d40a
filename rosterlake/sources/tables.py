"""The ten workforce tables: schemas, loading, appending, JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns and types of the data model, table by table. Keys are
# BIGINT so that a table may outgrow two billion rows.
SCHEMAS: dict[str, str] = {
    "departments": """
        department_id BIGINT NOT NULL, department_name STRING NOT NULL,
        budget DECIMAL(15,2) NOT NULL, manager_id BIGINT, location STRING,
        created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "positions": """
        position_id BIGINT NOT NULL, position_title STRING NOT NULL,
        position_level STRING NOT NULL, base_salary_min DECIMAL(10,2) NOT NULL,
        base_salary_max DECIMAL(10,2) NOT NULL, description STRING,
        requirements STRING, created_at TIMESTAMP_NTZ""",
    "employees": """
        employee_id BIGINT NOT NULL, first_name STRING NOT NULL, last_name STRING NOT NULL,
        email STRING NOT NULL, phone STRING, hire_date DATE NOT NULL,
        salary DECIMAL(12,2) NOT NULL, department_id BIGINT NOT NULL,
        position_id BIGINT NOT NULL, manager_id BIGINT, address STRING, birth_date DATE,
        is_active BOOLEAN, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "projects": """
        project_id BIGINT NOT NULL, project_name STRING NOT NULL, description STRING,
        department_id BIGINT NOT NULL, start_date DATE NOT NULL, end_date DATE,
        budget DECIMAL(15,2) NOT NULL, status STRING NOT NULL,
        project_manager_id BIGINT NOT NULL""",
    "employee_projects": """
        employee_project_id BIGINT NOT NULL, employee_id BIGINT NOT NULL,
        project_id BIGINT NOT NULL, role_in_project STRING NOT NULL,
        participation_percentage INT NOT NULL, start_date DATE NOT NULL,
        end_date DATE, hourly_rate DECIMAL(10,2)""",
    "salary_history": """
        salary_change_id BIGINT NOT NULL, employee_id BIGINT NOT NULL,
        old_salary DECIMAL(12,2) NOT NULL, new_salary DECIMAL(12,2) NOT NULL,
        change_date DATE NOT NULL, change_reason STRING NOT NULL,
        changed_by BIGINT NOT NULL, notes STRING""",
    "vacations": """
        vacation_id BIGINT NOT NULL, employee_id BIGINT NOT NULL,
        vacation_type STRING NOT NULL, start_date DATE NOT NULL,
        end_date DATE NOT NULL, days_count INT, status STRING NOT NULL,
        approved_by BIGINT, notes STRING""",
    "skills": """
        skill_id BIGINT NOT NULL, skill_name STRING NOT NULL, category STRING NOT NULL,
        description STRING, created_at TIMESTAMP_NTZ""",
    "employee_skills": """
        employee_skill_id BIGINT NOT NULL, employee_id BIGINT NOT NULL, skill_id BIGINT NOT NULL,
        proficiency_level STRING NOT NULL, certified BOOLEAN,
        certification_date DATE, notes STRING""",
    "audit_log": """
        log_id BIGINT NOT NULL, table_name STRING NOT NULL, record_id BIGINT NOT NULL,
        operation_type STRING NOT NULL, old_values STRING, new_values STRING,
        changed_by BIGINT, changed_at TIMESTAMP_NTZ""",
}


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables as lazy scans of ``<folder>/<table>.parquet`` with fixed schemas."""
    return {
        name: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")
        for name, schema in SCHEMAS.items()
    }


# What the reports filter or group by, followed by a key that splits a hot value.
CLUSTERED_BY: dict[str, tuple[str, ...]] = {
    "employees": ("department_id", "employee_id"),
    "projects": ("status", "project_id"),
    "employee_projects": ("project_id", "employee_id"),
    "salary_history": ("change_date", "employee_id"),
    "vacations": ("start_date", "employee_id"),
    "employee_skills": ("skill_id", "employee_id"),
    "audit_log": ("changed_at", "record_id"),
}


def save(
    tables: dict[str, DataFrame],
    folder: str,
    mode: str = "errorifexists",
    clustered: bool = False,
) -> None:
    """Write tables to the layout that :func:`load` reads.

    ``clustered`` orders large tables by what reports filter on, so that a filter
    skips files and row groups by their minima and maxima.
    """
    for name, df in tables.items():
        keys = CLUSTERED_BY.get(name)
        if clustered and keys:
            df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        df.write.mode(mode).parquet(f"{folder}/{name}.parquet")


def split_new(
    target: DataFrame, incoming: DataFrame, key: str, order: str
) -> tuple[DataFrame, DataFrame]:
    """Incoming rows that may be added, and the refused ones with ``refused``, the reason.

    Of the rows with one natural key the first in ``order`` (unique) may go in, unless
    ``target`` holds the key; rows without a key may not.
    """
    first = incoming.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first_row"))
    held = target.select(key).distinct().withColumn("is_held", F.lit(True))
    judged = (
        incoming.join(first, key, "left")
        .join(held, key, "left")
        .withColumn(
            "refused",
            F.when(F.col(key).isNull(), "no key")
            .when(F.col("is_held"), "key is held")
            .when(F.col(order) > F.col("first_row"), "key is repeated"),
        )
    )
    new = judged.filter("refused IS NULL").select(*incoming.columns)
    return new, judged.filter("refused IS NOT NULL").select(*incoming.columns, "refused")


def append_new(target: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """``target`` plus the incoming rows that :func:`split_new` lets in."""
    new, _ = split_new(target, incoming, key, order)
    return target.unionByName(new, allowMissingColumns=True)


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn by a seeded hash of their key, so the draw can be repeated.

    Each task keeps at most ``n`` of its own.
    """
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.orderBy(drawn, key).limit(n)


def json_record(*columns: str | Column) -> Column:
    """The columns as one JSON object that keeps null fields."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def to_records(df: DataFrame) -> DataFrame:
    """A report as one JSON object per row."""
    return df.select(json_record(*df.columns).alias("record"))
