"""What a batch of changes does to the promises of the tables, judged from the changed rows.

The full report (:func:`quality.constraint_report`) counts violations over everything. Here only rules of changed rows,
keys that changed rows take or free, and references to or from them are looked at; the rest of a table is
only asked for rows that hold one of those keys, one narrow column at a time.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import write_and_read
from . import quality


def _line(table: str, name: str, change: Column) -> Column:
    return F.struct(
        F.lit(table).alias("table_name"),
        F.lit(name).alias("constraint_name"),
        F.coalesce(change, F.lit(0)).cast("long").alias("change"),
    )


def _rules(table: str, signed: DataFrame, as_of: date) -> DataFrame:
    rules = quality._row_rules(table, signed, as_of)
    counted = signed.agg(*[F.sum(F.when(c, F.col("sign"))).alias(n) for n, c in rules.items()])
    return counted.select(F.inline(F.array(*[_line(table, n, F.col(f"`{n}`")) for n in rules])))


def _held(df: DataFrame, key: list[str], moved: DataFrame, name: str) -> DataFrame:
    """How many rows of ``df`` hold each of the keys in ``moved``."""
    asked = df.select(*key).join(moved.select(*key), key, "left_semi")
    return asked.groupBy(*key).agg(F.count("*").alias(name))


def _unique(table: str, name: str, key: list[str], present: Column, after: DataFrame, signed: DataFrame) -> DataFrame:
    """A key is one violation if more than one row holds it."""
    moved = signed.filter(present).groupBy(*key).agg(F.sum("sign").alias("net")).filter("net <> 0")
    held = _held(after.filter(present), key, moved, "held")
    now = F.coalesce("held", F.lit(0))
    change = (now > 1).cast("int") - (now - F.col("net") > 1).cast("int")
    return moved.join(held, key, "left").agg(F.sum(change).alias("n")).select(F.inline(F.array(_line(table, name, F.col("n")))))


def _reference(
    owner: str, column: str, parent: str, key: str, tables: dict[str, DataFrame], signed: dict[str, DataFrame]
) -> DataFrame:
    """Every row whose reference meets no parent is a violation."""
    nothing = F.lit(0)
    moves = []
    if owner in signed:
        moves.append(signed[owner].select(F.col(column).alias("value"), F.col("sign").alias("child"), nothing.alias("top")))
    if parent in signed:
        moves.append(signed[parent].select(F.col(key).alias("value"), nothing.alias("child"), F.col("sign").alias("top")))
    moved = moves[0] if len(moves) == 1 else moves[0].unionByName(moves[1])
    moved = (
        moved.filter("value IS NOT NULL")
        .groupBy("value")
        .agg(F.sum("child").alias("child"), F.sum("top").alias("top"))
        .filter("child <> 0 OR top <> 0")
    )
    children = _held(tables[owner].select(F.col(column).alias("value")), ["value"], moved, "children")
    parents = _held(tables[parent].select(F.col(key).alias("value")), ["value"], moved, "parents")
    children_now, parents_now = F.coalesce("children", F.lit(0)), F.coalesce("parents", F.lit(0))
    lost_now = F.when(parents_now == 0, children_now).otherwise(0)
    lost_before = F.when(parents_now - F.col("top") == 0, children_now - F.col("child")).otherwise(0)
    return (
        moved.join(children, "value", "left")
        .join(parents, "value", "left")
        .agg(F.sum(lost_now - lost_before).alias("n"))
        .select(F.inline(F.array(_line(owner, f"foreign key {column}", F.col("n")))))
    )


def change_report(
    tables: dict[str, DataFrame], changes: dict[str, tuple[DataFrame, DataFrame]], as_of: date
) -> DataFrame:
    """By how much each constraint's violations grew or shrank: the full report now less the one before.

    ``tables`` are as they are now; ``changes`` gives per table the rows removed and the rows added, a
    changed row being in both (:func:`snapshots.changed_rows`). One row per constraint that these changes can move.
    The changed rows are written once, so the planner knows their size. A table without
    changed rows moves nothing, NULL keys and references hold nothing, columns a table lacks count as NULL.
    """
    after = {name: quality._complete(name, df) for name, df in tables.items()}
    signed = {}
    for table, (removed, added) in changes.items():
        both = removed.withColumn("sign", F.lit(-1)).unionByName(added.withColumn("sign", F.lit(1)), allowMissingColumns=True)
        signed[table] = quality._complete(table, write_and_read(both, "signed"))
    parts = []
    for table, rows in signed.items():
        parts.append(_rules(table, rows, as_of))
        for name, key, condition in quality._keys_of(table):
            present = F.expr(condition)
            for column in key:
                present = present & F.col(column).isNotNull()
            parts.append(_unique(table, name, list(key), present, after[table], rows))
    for owner, column, parent, key in quality.REFERENCES:
        if owner in after and parent in after and (owner in signed or parent in signed):
            parts.append(_reference(owner, column, parent, key, after, signed))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
