"""Plans and jobs that have to hold when one key owns a third of all rows."""

import re
from datetime import date

import pytest
from conftest import DATA
from pyspark.sql import functions as F

import __spark_entry__ as driver
from rosterlake.operators import changes, hierarchy, listing, reports
from rosterlake.sources import intake, scratch, tables
from rosterlake.sources.fixtures import Fixtures

AS_OF = date(1999, 6, 30)
NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    # Coalescing would put test-sized data into one map task, which cannot be split.
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def split_hot_keys(spark):
    """Thresholds scaled down so that test-sized hot keys count as hot."""
    before = {k: spark.conf.get(k) for k in NO_BROADCAST if spark.conf.get(k, None)}
    for key, value in NO_BROADCAST.items():
        spark.conf.set(key, value)
    yield
    for key in NO_BROADCAST:
        if key in before:
            spark.conf.set(key, before[key])
        else:
            spark.conf.unset(key)


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """60,000 employees; one department and one manager own a third each."""
    folder = str(tmp_path_factory.mktemp("hot"))
    staff = spark.range(1, 60_001, 1, 8).selectExpr(
        "id AS employee_id",
        "'F' || id % 7 AS first_name",
        "'L' || id AS last_name",
        "'e' || id || '@x.org' AS email",
        "'1' AS phone",
        "DATE'1995-01-01' AS hire_date",
        "cast(1000 + id % 500 AS decimal(12,2)) AS salary",
        "CASE WHEN id % 3 = 0 THEN 1 ELSE id % 1000 + 1 END AS department_id",
        "id % 1000 + 1 AS position_id",
        """CASE WHEN id > 1 THEN CASE WHEN id % 3 = 1 THEN 1
           ELSE cast(id / 10 AS bigint) + 1 END END AS manager_id""",
        "id % 11 <> 10 AS is_active",
    )
    staff.write.parquet(f"{folder}/employees")
    spark.range(1, 1001).selectExpr(
        "id AS department_id", "'D' || id AS department_name", "cast(900000 AS decimal(15,2)) AS budget"
    ).write.parquet(f"{folder}/departments")
    spark.range(1, 1001).selectExpr(
        "id AS position_id",
        "'P' || id AS position_title",
        "'lead' AS position_level",
        "cast(1 AS decimal(10,2)) AS base_salary_min",
        "cast(1200 AS decimal(10,2)) AS base_salary_max",
    ).write.parquet(f"{folder}/positions")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in ("employees", "departments", "positions")}


def splits(df) -> int:
    """Joins that adaptive execution split after running ``df``."""
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    return len(re.findall(r"skew=true", final))


@pytest.mark.parametrize("name", list(driver.queries()))
def test_no_query_pairs_everything(spark, name):
    text = plan(driver.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text


def test_hot_department_and_manager_are_split(hot, split_hot_keys):
    detailed = reports.employee_details(
        hot["employees"], hot["departments"], hot["positions"], AS_OF, ordered=False
    ).agg(F.count("manager_email"), F.count("department_name"), F.max(F.xxhash64("email")))
    assert splits(detailed) >= 2
    limits = changes.budget_violations(hot["employees"], hot["departments"])
    over = limits.agg(F.count("*").alias("n"))
    assert splits(over) == 1
    assert over.collect()[0].n > 20_000 - 2_000


def test_hot_email_is_split(hot, split_hot_keys):
    requests = hot["employees"].selectExpr(
        "employee_id AS request_no",
        "CASE WHEN employee_id % 3 = 0 THEN 'same@x.org' ELSE 'n' || email END AS email",
        "department_id",
        "manager_id",
    )
    checked = intake.validate_new_employees(requests, hot["employees"], hot["departments"])
    counted = checked.agg(F.count("*").alias("n"), F.count("error").alias("refused"))
    assert splits(counted) >= 1
    assert tuple(counted.collect()[0]) == (60_000, 19_999)


def test_hot_manager_tree(hot, split_hot_keys):
    tree = hierarchy.employee_hierarchy(
        hot["employees"].withColumn("is_active", F.lit(True)),
        hot["departments"],
        hot["positions"],
        ordered=False,
    )
    assert tree.count() == tree.select("employee_id").distinct().count() == 60_000


def test_top_of_a_hot_group_is_cut_before_the_shuffle(hot):
    text = plan(listing.second_highest_paid(hot["employees"]))
    assert text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning")
    assert text.count("WindowGroupLimit") == 2


def test_filters_and_columns_reach_the_scan(spark, make, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    tables.save({n: make(n) for n in tables.SCHEMAS}, str(tmp_path / "t"))
    loaded = tables.load(spark, str(tmp_path / "t"))
    found = listing.search_employees(
        loaded["employees"],
        loaded["departments"],
        loaded["positions"],
        loaded["employee_skills"],
        loaded["skills"],
        department_id=3,
        min_salary=10,
    )
    scan = next(
        line for line in plan(found).splitlines() if "FileScan" in line and "email" in line
    )
    for condition in ("EqualTo(department_id,3)", "EqualTo(is_active,true)", "GreaterThanOrEqual(salary,10"):
        assert condition in scan
    assert "birth_date" not in scan.split("ReadSchema")[1]
    calendar = plan(
        reports.vacation_calendar(
            loaded["vacations"], loaded["employees"], loaded["departments"], loaded["positions"], AS_OF
        )
    )
    assert "In(status, [approved,taken])" in calendar


def test_scratch_tables_live_in_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch.scratch_folder(spark, "x").startswith(base + "/rosterlake-")
    written = scratch.write_and_read(spark.range(3), "kept")
    assert base in written.inputFiles()[0]


def test_a_report_reads_its_fact_table_once(spark):
    f = Fixtures(spark, DATA)
    text = plan(reports.department_salary_report(f.departments, f.employees, f.positions))
    assert len(re.findall(r"FileScan parquet \[c_custkey", text)) == 1


def test_order_lines_are_shuffled_once_for_vacations(spark):
    """With nothing broadcast, one shuffle of the lines and one of the orders."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = Fixtures(spark, DATA).vacations
        assert plan(rows).count("Exchange hashpartitioning") == 2
        assert rows.count() == rows.select("vacation_id").distinct().count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
