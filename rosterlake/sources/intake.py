"""Taking in employees and departments: CSV import and create requests."""

from __future__ import annotations

from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import labels
from ..operators import guards
from ..operators.quality import EMAIL_PATTERN
from .csv_records import read_csv_records
from .scratch import write_and_read
from .tables import json_record, split_new

# Columns of an import file.
CSV_COLUMNS = [
    "first_name",
    "last_name",
    "email",
    "hire_date",
    "salary",
    "department_id",
    "position_id",
    "manager_id",
]

# Texts that mean "no value" in an import file.
MISSING_TEXTS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


class Import(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame
    summary: DataFrame


# How dates are written in spreadsheets; month before day where both are possible.
DATE_FORMATS = [
    "yyyy-M-d",
    "yyyy/M/d",
    "yyyy.M.d",
    "yyyyMMdd",
    "M/d/yyyy",
    "d/M/yyyy",
    "M-d-yyyy",
    "d-M-yyyy",
    "M.d.yyyy",
    "d.M.yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
]

# The longest text a column takes.
LENGTHS = {"first_name": 100, "last_name": 100, "email": 255}


def read_date(text: str) -> Column:
    """A date column out of text in the first of the known forms that reads it."""
    shaped = F.regexp_replace(F.trim(F.col(text)), r"[T ]\d{1,2}:\d{2}.*$", "")
    return F.coalesce(
        *[F.to_date(F.try_to_timestamp(shaped, F.lit(form))) for form in DATE_FORMATS],
        F.expr(f"try_cast({text} as date)"),
    )


def _text(field: str | None, name: str) -> Column:
    """A column of an import file, NULL where its text means "no value" or the file does not have it."""
    if field is None:
        return F.lit(None).cast("string").alias(name)
    return F.when(~F.col(field).isin(MISSING_TEXTS), F.col(field)).alias(name)


def read_numbered_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Rows of CSV files as text with ``row_no`` in file order, counted from 1.

    With ``multi_line`` quoted fields may hold line breaks; :mod:`csv_records` finds where records
    start in files that are read in splits. Without it Spark's own reader cuts records at line ends.

    Positions run on within a split, so the splits' sizes give the offsets; only
    those, one row per split, meet in one task. They are written out, so that the
    planner sees how small they are and leaves the rows where they are.
    """
    if multi_line:
        records = read_csv_records(spark, path)
        present = records.schema["fields"].dataType.names
        return records.select("row_no", *[_text(f"fields.{c}" if c in present else None, c) for c in CSV_COLUMNS])
    lines = (
        spark.read.option("header", True)
        .option("escape", '"')
        .csv(path)
    )
    placed = lines.select(
        *[_text(c if c in lines.columns else None, c) for c in CSV_COLUMNS],
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"),
    )
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        placed.groupBy("file", "block")
        .agg(F.min("position").alias("first"), F.count("*").alias("n"))
        .select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    )
    return placed.join(write_and_read(splits, "splits"), ["file", "block"]).select(
        (F.col("offset") + F.col("position") - F.col("first") + 1).alias("row_no"), *CSV_COLUMNS
    )


def _known(keys: DataFrame, key: str, name: str) -> DataFrame:
    """Primary keys under another name, with a mark to find after a left join."""
    return keys.select(F.col(key).alias(name), F.lit(True).alias(f"{name}_known"))


def _decide(rows: DataFrame, existing: DataFrame, departments: DataFrame, number: str) -> DataFrame:
    """Adds ``email_taken`` and ``over_budget`` to ``rows``, as if they were taken in one by one.

    An address is taken if someone has it already or an earlier row got in with it. A row
    whose salary ``pay`` finds no room in its department's budget does not get in, so it
    neither takes room nor an address. Rows whose ``fault`` is set never get in.

    The two rules wait for each other, so they are applied in turn: the first to ask for an
    address that was not refused last time is taken to hold it, and the budget is spent among
    holders and those before them. A row depends on earlier rows only, so the one outcome that
    repeats itself is that of taking them in order; it is reached after as many turns as refusals
    depend on each other.

    The first row per email is a plain minimum, which does not gather the rows of one
    email in a task. The holders are written out and so shuffled on their own, which lets
    the join split an email that many rows share.
    """
    room = write_and_read(guards.payroll_room(departments, existing), "room")
    sound = rows.filter("fault IS NULL").select(
        F.col(number).alias("no"), "email", "department_id", guards.thousandths(F.col("pay")).alias("need")
    )
    # Room never grows: what does not fit at first is refused whatever happens before its turn.
    never = F.coalesce(F.col("need") > F.col("room"), F.lit(False))
    every = write_and_read(sound.join(room, "department_id", "left").withColumn("never", never).drop("room"), "sound")
    sound, hopeless = every.filter("NOT never").drop("never"), every.filter("never").select("no")
    held = existing.select("email", F.lit(-1).cast("long").alias("no"))

    def holders_of(accepted: DataFrame) -> DataFrame:
        both = held.unionByName(accepted.select("email", "no"))
        return write_and_read(both.groupBy("email").agg(F.min("no").alias("holder")), "holders")

    holders = holders_of(sound)
    while True:
        free = sound.join(holders, "email", "left").filter("holder IS NULL OR holder >= no")
        free = write_and_read(free.drop("holder"), "candidates")
        refused = guards.refused_by_budget(free.withColumn("take", F.col("need")), room)
        following = holders_of(sound.join(refused, "no", "left_anti"))
        moved = holders.join(following.withColumnRenamed("holder", "now"), "email", "full").filter("NOT holder <=> now")
        # Only addresses that another sound row asks for change anything.
        waiting = sound.join(moved, "email").filter("no <> coalesce(holder, now)")
        if waiting.isEmpty():
            break
        holders = following
    refused = refused.unionByName(hopeless)
    return (
        rows.join(holders, "email", "left")
        .join(refused.select(F.col("no").alias(number), F.lit(True).alias("refused")), number, "left")
        .withColumn("email_taken", F.coalesce(F.col("holder") < F.col(number), F.lit(False)))
        .withColumn("over_budget", F.coalesce("refused", F.lit(False)))
    )


def import_employees(
    lines: DataFrame,
    existing: DataFrame,
    departments: DataFrame,
    positions: DataFrame,
    as_of: date,
) -> Import:
    """Accept or reject the rows of :func:`read_numbered_csv`.

    The rows are parsed and checked once and written, then again with the outcome,
    which all three results read. The reason given
    is the first that applies: missing fields, address without ``@``, address in
    use, unreadable value, negative salary, broken table rule, payroll over budget.
    Rows count in order: what is refused neither takes an address nor room in a budget.
    """

    def number(name: str) -> Column:
        # Doubles only for what decimals cannot read, such as 1e5.
        return F.expr(
            f"coalesce(try_cast({name} as decimal(38,4)), try_cast(try_cast({name} as double) as decimal(38,4)))"
        )

    def whole(name: str) -> Column:
        # Keys of any size stay exact.
        return F.expr(
            f"coalesce(try_cast({name} as bigint), try_cast(try_cast({name} as decimal(38,4)) as bigint),"
            f" try_cast(try_cast({name} as double) as bigint))"
        )

    keys = ["department_id", "position_id", "manager_id"]
    typed = lines.select(
        "*",
        F.when(F.col("hire_date").isNull(), F.lit(as_of))
        .otherwise(read_date("hire_date"))
        .alias("hired"),
        F.when(F.col("salary").isNull(), F.lit(0)).otherwise(number("salary")).alias("pay"),
        *[whole(k).alias(f"{k}_read") for k in keys],
    )
    unreadable = F.col("hired").isNull() | F.col("pay").isNull()
    for key in keys:
        unreadable = unreadable | (F.col(key).isNotNull() & F.col(f"{key}_read").isNull())
    checked = (
        typed.join(_known(departments, "department_id", "department_id_read"), "department_id_read", "left")
        .join(_known(positions, "position_id", "position_id_read"), "position_id_read", "left")
        .join(_known(existing, "employee_id", "manager_id_read"), "manager_id_read", "left")
    )
    breaks_rule = (
        ~F.col("email").rlike(EMAIL_PATTERN)
        | F.col("last_name").isNull()
        | F.col("department_id_read_known").isNull()
        | F.col("position_id_read_known").isNull()
        | (F.col("manager_id_read").isNotNull() & F.col("manager_id_read_known").isNull())
        | (F.col("hired") > F.lit(as_of))
        | (F.col("pay") >= 10**10)
    )
    for column, most in LENGTHS.items():
        breaks_rule = breaks_rule | (F.length(column) > most)
    early = F.when(
        F.col("email").isNull() | F.col("first_name").isNull(), labels.MISSING_FIELDS
    ).when(~F.col("email").contains("@"), labels.BAD_EMAIL)
    late = (
        F.when(unreadable, labels.BAD_VALUE)
        .when(F.col("pay") < 0, labels.NEGATIVE_SALARY)
        .when(breaks_rule, labels.TABLE_RULE)
    )
    rows = write_and_read(
        checked.select(
            "row_no",
            *CSV_COLUMNS,
            "hired",
            "pay",
            *[f"{k}_read" for k in keys],
            early.alias("early"),
            F.coalesce(early, late).alias("fault"),
        ),
        "rows",
    )
    in_use = F.concat(
        F.lit(labels.EMAIL_EXISTS.split("{}")[0]),
        F.col("email"),
        F.lit(labels.EMAIL_EXISTS.split("{}")[1]),
    )
    reason = F.coalesce(
        F.col("early"),
        F.when(F.col("email_taken"), in_use),
        F.col("fault"),
        F.when(F.col("over_budget"), F.lit(labels.OVER_BUDGET)),
    )
    decided = write_and_read(
        _decide(
            rows.withColumn("raw_department", F.col("department_id")).withColumn("department_id", F.col("department_id_read")),
            existing, departments, "row_no",
        ).withColumn("department_id", F.col("raw_department")).select(
            "row_no",
            *CSV_COLUMNS,
            "hired",
            F.when(F.col("fault").isNull(), F.col("pay")).cast("decimal(12,2)").alias("pay"),
            *[f"{k}_read" for k in keys],
            reason.alias("reason"),
        ),
        "import",
    )
    accepted = decided.filter("reason IS NULL").select(
        "row_no",
        "first_name",
        "last_name",
        "email",
        F.col("hired").alias("hire_date"),
        F.col("pay").alias("salary"),
        *[F.col(f"{k}_read").alias(k) for k in keys],
    )
    before, after = labels.ROW_PREFIX.split("{}")
    rejected = decided.filter("reason IS NOT NULL").select(
        F.col("row_no").alias("row"),
        json_record(*CSV_COLUMNS).alias("data"),
        F.concat(F.lit(before), F.col("row_no").cast("string"), F.lit(after), F.col("reason")).alias(
            "error"
        ),
    )
    summary = decided.agg(
        F.count_if(F.col("reason").isNull()).alias("success"),
        F.count_if(F.col("reason").isNotNull()).alias("failed"),
        F.count("*").alias("total_processed"),
    )
    return Import(accepted, rejected, summary)


def validate_new_employees(
    requests: DataFrame, employees: DataFrame, departments: DataFrame, number: str = "request_no"
) -> DataFrame:
    """Create requests with ``error``, NULL where the employee may be created.

    ``number`` orders the requests; an earlier request that goes through takes its email
    and, if requests have a ``salary``, room in its department's budget.
    """
    checked = requests.join(
        _known(departments, "department_id", "department_id"), "department_id", "left"
    ).join(_known(employees, "employee_id", "manager_id"), "manager_id", "left")

    def unknown(key: str) -> Column:
        # 0 stands for "not given", as NULL does.
        return F.coalesce(F.col(key) != 0, F.lit(False)) & F.col(f"{key}_known").isNull()

    fault = F.when(unknown("department_id"), labels.NO_SUCH_DEPARTMENT).when(
        unknown("manager_id"), labels.NO_SUCH_MANAGER
    )
    pay = F.col("salary") if "salary" in requests.columns else F.lit(None).cast("decimal(12,2)")
    judged = _decide(checked.withColumn("fault", fault).withColumn("pay", pay), employees, departments, number)
    over = F.when(F.col("over_budget"), labels.OVER_BUDGET)
    return judged.select(
        *requests.columns,
        F.when(F.col("email_taken"), labels.EMAIL_USED).otherwise(F.coalesce("fault", over)).alias("error"),
    )


def create_departments(
    requests: DataFrame, departments: DataFrame, number: str = "department_id"
) -> tuple[DataFrame, DataFrame]:
    """Departments plus the requested ones whose name is new, and the refused requests.

    ``number`` orders the requests; the first to ask for a name gets it.
    """
    new, refused = split_new(departments, requests, "department_name", number)
    return departments.unionByName(new, allowMissingColumns=True), refused
