"""Rules that judge rows one after the other, as jobs over all of them.

``refused_by_budget`` admits requests in order while a department has room, ``refused_loops``
accepts new reporting lines in order while none closes a loop, ``refused_addresses`` finds who
must keep an address because somebody else does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import write_and_read

#: Rows of a block of neighbours in a running sum, and changed lines that are judged at a time.
BLOCK_ROWS, LINES_AT_ONCE = 65536, 16384
#: Spans of turns that more changed lines are split into, at most.
SPANS = 32
#: Requests of one department that a task walks through in one go.
AT_ONCE = 100_000

# Fixed value: payroll may take seven tenths of a department's budget.
PAYROLL_TENTHS = 7


def join_by_key(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the employees.

    Packed numbers make a small file, by which the planner would send a table of a million rows to
    the driver and from there to everyone, in each of many rounds. Both sides are shuffled instead.
    """
    return left.join(right.hint("merge"), on, how)


def thousandths(amount: Column) -> Column:
    """An amount with two decimals in thousandths, in which seven tenths of a budget are whole."""
    return (amount.cast("decimal(17,2)") * 1000).cast("long")


def payroll_room(departments: DataFrame, employees: DataFrame) -> DataFrame:
    """(department_id, room): what payroll may still take, in thousandths; below 0 if it takes too much.

    Departments without a budget have no limit and no row.
    """
    fund = employees.filter("is_active").groupBy("department_id").agg(F.sum("salary").alias("fund"))
    limit = (F.col("budget").cast("decimal(17,2)") * 100 * PAYROLL_TENTHS).cast("long")
    return (
        departments.filter("budget IS NOT NULL")
        .join(fund, "department_id", "left")
        .select("department_id", (limit - F.coalesce(thousandths(F.col("fund")), F.lit(0))).alias("room"))
    )


def _running(rows: DataFrame, amount: Column) -> DataFrame:
    """Adds ``before``: the sum of ``amount`` over earlier rows of the department.

    Blocks of neighbours are summed first, so that a department with most of the rows is spread.
    """
    blocked = rows.withColumn("amount", amount).withColumn("block", F.expr(f"no div {BLOCK_ROWS}"))
    blocks = blocked.groupBy("department_id", "block").agg(F.sum("amount").alias("total"))
    earlier = Window.partitionBy("department_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        F.col("department_id").alias("d"), F.col("block").alias("b"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("department_id", "block").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    summed = blocked.withColumn("inner", F.coalesce(F.sum("amount").over(within), F.lit(0)))
    joined = summed.join(offsets, (F.col("department_id") == F.col("d")) & (F.col("block") == F.col("b")))
    return joined.withColumn("before", F.col("offset") + F.col("inner")).drop("d", "b", "block", "offset", "inner", "amount")


def _in_turn(requests: pa.Table) -> pa.Table:
    """The refused among some requests of one department, one by one."""
    rows = sorted(zip(*(requests.column(c).to_pylist() for c in ("no", "need", "take", "room")), strict=True))
    room, refused = rows[0][3], []
    for no, need, take, _ in rows:
        if need > room:
            refused.append(no)
        else:
            room -= max(take, 0)
    return pa.table({"no": pa.array(refused, pa.int64())})


def _round(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refused, left): what a round of :func:`refused_by_budget` decides and what it leaves."""
    power = F.expr("CASE WHEN room >= 1 THEN shiftleft(1L, cast(floor(log2(room)) as int)) ELSE 0 END")
    # log2 is a double: near a power of two it may be one off.
    sized = left.withColumn("p", power)
    sized = sized.withColumn("p", F.expr("CASE WHEN p > room THEN p div 2 WHEN p > 0 AND 2 * p <= room THEN 2 * p ELSE p END"))
    small = (F.col("need") < F.col("p")) & (F.col("take") > 0)
    judged = _running(sized, F.when(small, F.col("take")).otherwise(0))
    rest = F.col("room") - F.col("before")
    fits = F.when(F.col("p") == 0, F.col("need") <= F.col("room")).otherwise(F.col("need") <= rest)
    ends = (F.col("p") > 0) & (F.col("take") > 0) & (
        F.when(F.col("need") < F.col("p"), rest - F.col("take") < F.col("p")).otherwise(fits)
    )
    judged = write_and_read(judged.withColumn("fits", fits).withColumn("ends", ends), "judged")
    event = (
        judged.filter("ends")
        .groupBy("department_id")
        .agg(F.min(F.struct("no", (F.col("room") - F.col("before") - F.col("take")).alias("room"))).alias("event"))
        .select(F.col("department_id").alias("d"), F.col("event.no").alias("last"), F.col("event.room").alias("next_room"))
    )
    met = judged.join(event, F.col("department_id") == F.col("d"), "left")
    refused = met.filter("last IS NULL OR no <= last").filter("NOT fits").select("no")
    return refused, met.filter("no > last").select("no", "department_id", "need", "take", F.col("next_room").alias("room"))


def refused_by_budget(requests: DataFrame, room: DataFrame) -> DataFrame:
    """(no): which of ``requests(no, department_id, need, take)`` find no room in their turn.

    A request goes in if its need fits into what is left, and takes ``take`` (its need, or
    0 or less for nothing); one that is refused takes nothing, so a later, smaller one may still fit.
    ``no`` is unique. Departments without a row in ``room`` have no limit.

    No prefix sum tells who is refused, but this does: let p be the largest power of two up
    to the room. Needs of 2p and more never fit again. Needs below p fit until their running
    sum brings the room below p; a need between fits if it fits into the room less that sum, and
    then brings it below p, too. Whichever happens first ends a round and decides all rows up to it.
    Every round halves a department's room at least, so rounds grow with the number of its digits,
    not with rows, and all departments go through them together. A department with no more than
    ``AT_ONCE`` requests left is walked through in one go, which gives the same.
    """
    open_ = write_and_read(requests.join(room, "department_id").select("no", "department_id", "need", "take", "room"), "requests")
    # The room never grows, so these never fit.
    refused = open_.filter("need > room").select("no")
    left, short = open_.filter("need <= room"), None
    while True:
        many = left.groupBy("department_id").agg(F.count("*").alias("n")).filter(F.col("n") > AT_ONCE).select("department_id")
        many = write_and_read(many, "large_departments")
        few = left.join(many, "department_id", "left_anti")
        short = few if short is None else short.unionByName(few)
        if many.isEmpty():
            walked = short.groupBy("department_id").applyInArrow(_in_turn, "no long")
            return write_and_read(refused.unionByName(walked), "over_budget")
        more, left = _round(left.join(many, "department_id", "left_semi"))
        refused, left = refused.unionByName(more), write_and_read(left, "requests")


# --- reporting lines -------------------------------------------------------------


def _nearest(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """(employee_id, stop): the first of ``stops`` at or above each employee, by jumping.

    Whose line reaches none, or runs in circles, has no row.
    """
    at_stop = stops.select("employee_id", F.col("employee_id").alias("stop"))
    pending = join_by_key(edges, stops, "employee_id", "left_anti").filter("manager_id IS NOT NULL")
    pending = write_and_read(pending.select("employee_id", F.col("manager_id").alias("top")), "pending")
    found, left = at_stop, pending.count()
    while left:
        step = pending.select(F.col("employee_id").alias("top"), F.col("top").alias("next"))
        known = found.select(F.col("employee_id").alias("top"), "stop")
        jumped = join_by_key(join_by_key(pending, known, "top", "left"), step, "top", "left")
        jumped = write_and_read(jumped.filter("stop IS NOT NULL OR next IS NOT NULL"), "jumped")
        found = found.unionByName(jumped.filter("stop IS NOT NULL").select("employee_id", "stop"))
        pending = jumped.filter("stop IS NULL").select("employee_id", F.col("next").alias("top"))
        before, left = left, pending.count()
        if left == before:  # only circles never end, and whoever is below one
            break
    return found


def _closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of a block's changes close a loop, in order; lines lead from stop to stop."""
    rows = [row for batch in batches for row in batch.to_pylist()]
    above = {row["employee_id"]: row["old_stop"] for row in rows if row["old_stop"] is not None}
    refused = []
    for row in sorted(rows, key=lambda row: row["turn"]):
        who, at = row["employee_id"], row["new_stop"]
        while at is not None and at != who:
            at = above.get(at)
        if at is not None:
            refused.append(who)
        elif row["new_stop"] is None:
            above.pop(who, None)
        else:
            above[who] = row["new_stop"]
    yield pa.RecordBatch.from_arrays([pa.array(refused, pa.int64())], names=["employee_id"])


def _contracted(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """(employee_id, turn, old_stop, new_stop): where the old and the new line first meet someone whose line changes."""
    stops = _nearest(edges, changes.select("employee_id"))
    old = join_by_key(edges, changes.select("employee_id"), "employee_id", "left_semi").select(
        "employee_id", F.col("manager_id").alias("old_manager")
    )
    lines = join_by_key(changes, old, "employee_id", "left")
    lines = join_by_key(lines, stops.toDF("manager_id", "new_stop"), "manager_id", "left")
    lines = join_by_key(lines, stops.toDF("old_manager", "old_stop"), "old_manager", "left")
    return lines.select("employee_id", "turn", "old_stop", "new_stop").distinct()


def refused_loops(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """(employee_id): which of ``changes(employee_id, turn, manager_id)`` would close a loop in their turn.

    ``edges(employee_id, manager_id)`` are the lines before. Changes are judged in the order of
    ``turn`` (unique, one change an employee); one that is refused leaves the line as it was.

    The lines that stay are contracted to the employees whose line changes, by jumping. Some
    thousand changes are walked in order. More of them are split into spans of turns, which are judged one after
    the other on what is left of the lines, each going on from the lines that came out of the one before: all
    employees are read once, and a block meets only the changes of the span that it is in.
    """
    changes = write_and_read(changes, "changed_lines")
    many = changes.count()
    if not many:
        return changes.select("employee_id")
    lines = write_and_read(_contracted(edges, changes), "contracted")
    ends: list = []
    if many > LINES_AT_ONCE:
        spans = max(2, min(SPANS, 11 * many // (10 * LINES_AT_ONCE) + 1))
        ends = changes.approxQuantile("turn", [n / spans for n in range(1, spans)], 0.002)
        first, last = changes.agg(F.min("turn"), F.max("turn")).first()
        ends = sorted({int(end) for end in ends if first <= end < last})
    if not ends:
        closing = lines.coalesce(1).mapInArrow(_closing, "employee_id long")
        return write_and_read(closing, "closing")
    now = lines.select("employee_id", F.col("old_stop").alias("manager_id"))
    refused = None
    for after, end in zip([None, *ends], [*ends, None], strict=True):
        span = lines
        if after is not None:
            span = span.filter(F.col("turn") > after)
        if end is not None:
            span = span.filter(F.col("turn") <= end)
        closing = refused_loops(now, span.select("employee_id", "turn", F.col("new_stop").alias("manager_id")))
        refused = closing if refused is None else refused.unionByName(closing)
        if end is None:
            return refused
        moved = join_by_key(span, closing, "employee_id", "left_anti").select(
            "employee_id", F.col("new_stop").alias("new_manager"), F.lit(True).alias("moved")
        )
        now = join_by_key(now, moved, "employee_id", "left").select(
            "employee_id", F.when(F.col("moved"), F.col("new_manager")).otherwise(F.col("manager_id")).alias("manager_id")
        )
        now = write_and_read(now, "lines")


# --- addresses -------------------------------------------------------------------


def refused_addresses(asks: DataFrame, owners: DataFrame, kept: DataFrame) -> DataFrame:
    """(employee_id): whose wish for an address fails because its owner keeps it.

    ``asks(employee_id, email)`` are wishes that nobody else has, ``owners(employee_id, email)``
    the addresses before, ``kept(employee_id)`` who is refused already. An owner without a wish
    keeps the address, and so does one whose own wish fails. Each wish waits for one owner, so
    chains are followed by jumping; a ring of wishes can be granted as one.
    """
    owner = owners.filter("email IS NOT NULL").select(F.col("employee_id").alias("owner"), "email")
    waits = join_by_key(asks, owner, "email").filter("owner <> employee_id").select("employee_id", F.col("owner").alias("on"))
    pending = write_and_read(join_by_key(waits, kept, "employee_id", "left_anti"), "waits")
    asking = join_by_key(asks.select("employee_id"), kept, "employee_id", "left_anti")
    # Fails at once: the owner keeps it.
    keeps = join_by_key(pending, asking.select(F.col("employee_id").alias("on")), "on", "left_anti")
    fails = write_and_read(keeps.select("employee_id"), "fails")
    pending = write_and_read(join_by_key(pending, fails, "employee_id", "left_anti"), "waits")
    left = pending.count()
    while left:
        step = pending.select(F.col("employee_id").alias("on"), F.col("on").alias("next"))
        bad = fails.select(F.col("employee_id").alias("on"), F.lit(True).alias("bad"))
        jumped = join_by_key(join_by_key(pending, bad, "on", "left"), step, "on", "left")
        # Neither fails nor waits any more: it is granted, and so is the wish for it.
        jumped = write_and_read(jumped.filter("bad OR next IS NOT NULL"), "jumped")
        fails = fails.unionByName(jumped.filter("bad").select("employee_id"))
        pending = jumped.filter("bad IS NULL").select("employee_id", F.col("next").alias("on"))
        before, left = left, pending.count()
        if left == before:  # rings
            break
    return fails
