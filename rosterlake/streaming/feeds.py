"""Jobs over a feed of salary changes; each has the same form in batch.

A change carries ``change_id``, ``changed_at``, ``employee_id``, ``operation``,
``old_salary`` and ``new_salary``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import DEFAULT_REASON, SYSTEM_USER
from ..sources.scratch import scratch_folder, write_and_read
from ..sources.tables import json_record
from .seen import new_changes, versions, write_version

#: Buckets that people's last changes are dealt to.
BUCKETS = 16
_NEVER = 1 << 62


def read_feed(
    spark: SparkSession, folder: str, file_glob: str, schema: str, max_files: int = 1000
) -> DataFrame:
    """Parquet files of a folder as they arrive, ``max_files`` to a batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", file_glob)
        .option("maxFilesPerTrigger", max_files)
        .parquet(folder)
    )


def audit_rows(changes: DataFrame, changed_by: int = SYSTEM_USER) -> DataFrame:
    """Audit rows of a feed: a projection, so a stream needs no state."""

    def shown(column: str, absent: str) -> Column:
        record = json_record(F.col(column).alias("salary"))
        return F.when(F.col("operation") != absent, record)

    return changes.select(
        F.lit("employees").alias("table_name"),
        F.col("employee_id").alias("record_id"),
        F.col("operation").alias("operation_type"),
        shown("old_salary", "INSERT").alias("old_values"),
        shown("new_salary", "DELETE").alias("new_values"),
        F.lit(changed_by).cast("long").alias("changed_by"),
        "changed_at",
    )


def history_rows(
    changes: DataFrame, reason: str = DEFAULT_REASON, changed_by: int = SYSTEM_USER
) -> DataFrame:
    """Salary history rows of a feed: updates that raise a salary."""
    return changes.filter(
        (F.col("operation") == "UPDATE") & (F.col("new_salary") > F.col("old_salary"))
    ).select(
        F.col("change_id").alias("salary_change_id"),
        "employee_id",
        "old_salary",
        "new_salary",
        F.to_date("changed_at").alias("change_date"),
        F.lit(reason).alias("change_reason"),
        F.lit(changed_by).cast("long").alias("changed_by"),
    )


def department_movement(changes: DataFrame, employees: DataFrame) -> DataFrame:
    """What a feed has done to each department's heads and fund so far.

    Changes of people the employee table does not know yet (hires) count under a NULL department.
    """
    operation = F.col("operation")
    old = F.when(operation != "INSERT", F.col("old_salary")).otherwise(0)
    new = F.when(operation != "DELETE", F.col("new_salary")).otherwise(0)
    heads = F.when(operation == "INSERT", 1).when(operation == "DELETE", -1).otherwise(0)
    return (
        changes.join(employees.select("employee_id", "department_id"), "employee_id", "left")
        .groupBy("department_id")
        .agg(
            F.count("*").alias("changes"),
            F.sum(heads).alias("head_change"),
            F.sum(new - old).alias("fund_change"),
            F.max("new_salary").alias("highest_salary"),
        )
    )


def department_figures(changes: DataFrame, employees: DataFrame) -> DataFrame:
    """Current fund, average and lowest pay per department after a feed.

    The last change of a person decides; repeated deliveries change nothing, and who left
    or is not active is not paid. Changes are reduced to one row a person before they join.
    """
    last = changes.groupBy("employee_id").agg(
        F.max_by(F.struct("operation", "new_salary"), F.struct("changed_at", "change_id")).alias("last")
    )
    pay = F.when(F.col("last").isNull(), F.col("salary")).when(
        F.col("last.operation") != "DELETE", F.col("last.new_salary")
    )
    paid = employees.filter("is_active").join(last, "employee_id", "left").select("department_id", pay.alias("pay"))
    return paid.groupBy("department_id").agg(
        F.count("pay").alias("paid"),
        F.sum("pay").alias("fund"),
        F.avg("pay").alias("avg_salary"),
        F.min("pay").alias("min_salary"),
    )


def drain_rows(stream: DataFrame, label: str) -> DataFrame:
    """Append what the source holds to a table, then read the table.

    The empty start lets the table be read when the source holds nothing.
    """
    spark = stream.sparkSession
    folder = scratch_folder(spark, label)
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows")
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _drain(changes: DataFrame, folder: str, write_batch: Callable[[DataFrame, int], None]) -> None:
    """Hand every batch's new changes to ``write_batch``, which overwrites what it wrote for the batch before."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write_batch(new_changes(batch, batch_id, f"{folder}/ids"), batch_id)

    query = (
        changes.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drain_once(changes: DataFrame, rows_of: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """``rows_of`` every change of a stream, once each however often it is delivered, as a table."""
    spark = changes.sparkSession
    folder = scratch_folder(spark, label)
    empty = rows_of(spark.createDataFrame([], changes.schema))
    empty.write.parquet(f"{folder}/rows/batch=-1")
    _drain(
        changes,
        folder,
        lambda new, batch_id: rows_of(new).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}"),
    )
    return spark.read.schema(empty.schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").select(*empty.columns)


def stream_department_movement(changes: DataFrame, employees: DataFrame, label: str) -> DataFrame:
    """The running form of :func:`department_movement`: drain a stream of changes, read the sums.

    Every change counts once, however often and however late it is delivered
    (:mod:`rosterlake.streaming.seen`); a batch adds one row a department.
    """
    stored = drain_once(changes, lambda new: department_movement(new, employees), label)
    return stored.groupBy("department_id").agg(
        *[F.sum(c).alias(c) for c in ("changes", "head_change")],
        F.sum("fund_change").cast(stored.schema["fund_change"].dataType).alias("fund_change"),
        F.max("highest_salary").alias("highest_salary"),
    )


def stream_department_figures(changes: DataFrame, employees: DataFrame, label: str, buckets: int = BUCKETS) -> DataFrame:
    """The running form of :func:`department_figures`.

    People are dealt to ``buckets`` by a hash. A batch reads and writes only the buckets of people
    it has changes for: their last changes, and what each department's people in that bucket are
    paid (number, sum, lowest). Sums are made anew for the touched buckets, so a lowest salary can rise
    again. A department's figures are those of its buckets together.
    """
    spark = changes.sparkSession
    folder = scratch_folder(spark, label)
    bucket = F.pmod(F.xxhash64("employee_id"), F.lit(buckets)).cast("int").alias("bucket")
    staff = employees.filter("is_active").select("employee_id", "department_id", "salary", bucket)
    staff.write.partitionBy("bucket").parquet(f"{folder}/staff")
    staff = spark.read.schema(staff.schema).parquet(f"{folder}/staff")
    last = F.max_by(F.struct("operation", "new_salary"), F.struct("changed_at", "change_id")).alias("last")
    state = "employee_id long, changed_at timestamp, change_id long, operation string, new_salary decimal(12,2)"
    names = [c.split()[0] for c in state.split(", ")]

    def paid(people: DataFrame, changed: DataFrame) -> DataFrame:
        mine = changed.groupBy("employee_id").agg(last)
        pay = F.when(F.col("last").isNull(), F.col("salary")).when(
            F.col("last.operation") != "DELETE", F.col("last.new_salary")
        )
        joined = people.join(mine, "employee_id", "left").select("department_id", "bucket", pay.alias("pay"))
        return joined.groupBy("department_id", "bucket").agg(
            F.count("pay").alias("paid"), F.sum("pay").alias("fund"), F.min("pay").alias("min_salary")
        )

    def write_batch(new: DataFrame, batch_id: int) -> None:
        delivered = new.select(*names, bucket)
        touched = sorted(r["bucket"] for r in delivered.select("bucket").distinct().collect())  # at most ``buckets``
        before = [
            f"{folder}/last/bucket={k}/{name}"
            for k in touched
            for _, name in versions(spark, f"{folder}/last/bucket={k}", batch_id)
        ]
        if before:
            stored = spark.read.schema(f"{state}, bucket int, version string").option("basePath", f"{folder}/last").parquet(*before)
            delivered = delivered.unionByName(stored.select(*names, "bucket"))
        newest = F.max_by(F.struct(*names), F.struct("changed_at", "change_id")).alias("newest")
        kept = write_and_read(delivered.groupBy("employee_id", "bucket").agg(newest).select("newest.*", "bucket"), "last_changes")
        figures = write_and_read(paid(staff.filter(F.col("bucket").isin(touched)), kept.drop("bucket")), "bucket_figures")
        write_version(kept, f"{folder}/last", "bucket", "whole", batch_id)
        write_version(figures, f"{folder}/paid", "bucket", "whole", batch_id)

    start = paid(staff, spark.createDataFrame([], state))
    start.write.parquet(f"{folder}/start")
    start = spark.read.schema(start.schema).parquet(f"{folder}/start")
    _drain(changes, folder, write_batch)
    current = [(k, versions(spark, f"{folder}/paid/bucket={k}", _NEVER)) for k in range(buckets)]
    paths = [f"{folder}/paid/bucket={k}/{known[-1][1]}" for k, known in current if known]
    rows = start.filter(~F.col("bucket").isin([k for k, known in current if known]))
    if paths:
        columns = "department_id long, bucket int, paid long, fund decimal(22,2), min_salary decimal(12,2), version string"
        later = spark.read.schema(columns).option("basePath", f"{folder}/paid").parquet(*paths)
        rows = rows.unionByName(later.drop("version").select(*rows.columns))
    total = rows.groupBy("department_id").agg(
        F.sum("paid").alias("paid"), F.sum("fund").cast("decimal(22,2)").alias("fund"), F.min("min_salary").alias("min_salary")
    )
    average = (F.col("fund") / F.nullif(F.col("paid"), F.lit(0)).cast("decimal(10,0)")).cast("decimal(16,6)")
    return total.select("department_id", "paid", "fund", average.alias("avg_salary"), "min_salary")
