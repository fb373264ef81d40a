from decimal import Decimal

from conftest import DATA
from pyspark.sql import functions as F

from rosterlake.sources.fixtures import BASE_SCHEMAS, Fixtures
from rosterlake.streaming import feeds, seen

CHANGE_SCHEMA = (
    "change_id long, changed_at timestamp, employee_id long, operation string, "
    "old_salary decimal(12,2), new_salary decimal(12,2)"
)


def feed(spark, f):
    return f.change_columns(feeds.read_feed(spark, DATA, "events.parquet", BASE_SCHEMAS["events"]))


def same(left, right):
    columns = sorted(left.columns)
    return sorted(left.select(columns).collect(), key=str) == sorted(
        right.select(columns).collect(), key=str
    )


def test_rows_of_the_stream_equal_the_batch(spark):
    f = Fixtures(spark, DATA)
    audit = feeds.drain_once(feed(spark, f), feeds.audit_rows, "audit")
    assert same(audit, feeds.audit_rows(f.changes))
    history = feeds.drain_once(feed(spark, f), feeds.history_rows, "history")
    assert same(history, feeds.history_rows(f.changes))


def test_movement_over_many_batches_with_retries(spark, tmp_path):
    f = Fixtures(spark, DATA)
    changes = f.changes.withColumn("slice", F.col("change_id") % 3)
    folder = str(tmp_path / "feed")
    for i in range(3):
        # The last delivery repeats the first.
        part = changes.filter((F.col("slice") == i) | ((F.col("slice") == 0) & F.lit(i == 2)))
        part.drop("slice").coalesce(1).write.mode("append").parquet(folder)
    stream = (
        spark.readStream.schema(CHANGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    )
    drained = feeds.stream_department_movement(stream, f.employees, "movement")
    assert same(drained, feeds.department_movement(f.changes, f.employees))
    counted = drained.agg({"changes": "sum"}).first()[0]
    assert counted == f.changes.count()


def test_movement_counts_people_the_table_does_not_know(spark, tmp_path):
    f = Fixtures(spark, DATA)
    known = f.employees.filter("employee_id % 2 = 0")
    f.changes.coalesce(1).write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(CHANGE_SCHEMA).parquet(str(tmp_path / "feed"))
    drained = feeds.stream_department_movement(stream, known, "hires")
    assert same(drained, feeds.department_movement(f.changes, known))
    assert drained.filter("department_id IS NULL").count() == 1


def test_empty_source(spark, tmp_path):
    folder = tmp_path / "nothing"
    folder.mkdir()
    stream = spark.readStream.schema(CHANGE_SCHEMA).parquet(str(folder))
    assert feeds.drain_once(stream, feeds.history_rows, "none").count() == 0
    f = Fixtures(spark, DATA)
    assert feeds.stream_department_movement(stream, f.employees, "none").count() == 0


def deliveries(changes, folder, *parts):
    """A file, and so a batch, for each condition."""
    for part in parts:
        changes.filter(part).coalesce(1).write.mode("append").parquet(folder)


def test_repeated_deliveries_change_nothing(spark, tmp_path):
    f, folder = Fixtures(spark, DATA), str(tmp_path / "feed")
    deliveries(f.changes, folder, "change_id % 2 = 0", "change_id % 2 = 1", "change_id % 2 = 0", "true")
    stream = spark.readStream.schema(CHANGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    assert same(feeds.drain_once(stream, feeds.audit_rows, "audit"), feeds.audit_rows(f.changes))
    assert same(feeds.drain_once(stream, feeds.history_rows, "history"), feeds.history_rows(f.changes))
    figures = feeds.stream_department_figures(stream, f.employees, "figures", buckets=3)
    assert same(figures, feeds.department_figures(f.changes, f.employees))


def test_a_lowest_salary_can_rise_again(spark, tmp_path, make):
    people = make("employees", *[{"employee_id": i, "salary": Decimal(100 + i), "department_id": 1} for i in range(1, 6)])
    rows = [(1, "2024-01-01", 1, "UPDATE", 50), (2, "2024-01-02", 2, "DELETE", None), (3, "2024-01-03", 1, "UPDATE", 500), (4, "2024-01-02", 1, "UPDATE", 40)]
    values = ", ".join(f"({i}L, timestamp'{at}', {who}L, '{op}', cast(null as decimal(12,2)), cast({pay or 'null'} as decimal(12,2)))" for i, at, who, op, pay in rows)
    changes = spark.sql(f"select * from values {values} as t(change_id, changed_at, employee_id, operation, old_salary, new_salary)")
    folder = str(tmp_path / "feed")
    deliveries(changes, folder, "change_id = 1", "change_id = 2", "change_id = 3", "change_id = 4", "change_id = 1")
    stream = spark.readStream.schema(CHANGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    (row,) = feeds.stream_department_figures(stream, people, "figures", buckets=2).collect()
    assert (row.paid, row.fund, row.min_salary) == (4, 103 + 104 + 105 + 500, 103)


def test_a_batch_reads_only_the_days_it_delivers(spark, tmp_path, monkeypatch):
    """The store's reads are pruned to the batch's days, and folders do not grow with batches."""
    f, store = Fixtures(spark, DATA), str(tmp_path / "ids")
    day = "date_trunc('day', changed_at)"
    first = f.changes.selectExpr(f"min({day})").first()[0]
    some = f.changes.filter(F.expr(day) == F.lit(first))
    assert seen.new_changes(f.changes, 0, store).count() == f.changes.count()
    plans, original = [], seen.write_and_read

    def watched(df, label):
        plans.append(df._jdf.queryExecution().toString())
        return original(df, label)

    monkeypatch.setattr(seen, "write_and_read", watched)
    for batch_id in range(1, 20):
        assert seen.new_changes(some, batch_id, store).count() == 0
    assert f"day={first:%Y-%m-%d}" in plans[-1] or "PartitionFilters: [isnotnull(day" in plans[-1]
    assert len(seen.versions(spark, f"{store}/day={first:%Y-%m-%d}", 20)) <= seen.MERGE_AFTER + 1
    assert seen.new_changes(some, 19, store).count() == 0  # tried again
