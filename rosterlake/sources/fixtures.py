"""The workforce tables derived from the driver's star-schema tables.

``FIXTURES.md`` describes the mapping; ``plans/oracle.py`` states the same
mapping in SQL. Everything stays lazy, so a query only pays for the tables and
columns it reads.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = date(1999, 6, 30)


# Columns of the driver's tables. A given schema saves the job that
# would read it from the files.
BASE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": """c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE,
                   c_mktsegment STRING""",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": """p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT,
               p_retailprice DOUBLE""",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING,
                 o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING""",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,
                   l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,
                   l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ""",
    "events": """event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING,
                 value DOUBLE, props STRING""",
}


class Fixtures:
    """Lazy workforce tables over one driver folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.schema(BASE_SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    @property
    def departments(self) -> DataFrame:
        staff = self.base("customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
        nation = self.base("nation")
        return (
            nation.join(self.base("region"), nation.n_regionkey == F.col("r_regionkey"))
            .join(staff, nation.n_nationkey == staff.c_nationkey, "left")
            .selectExpr(
                "cast(n_nationkey + 1 as bigint) AS department_id",
                "n_name AS department_name",
                """cast(CASE WHEN n_nationkey % 13 = 12 THEN 0
                        ELSE coalesce(n, 0) * (70000 + 9000 * (n_nationkey % 9)) END
                   AS decimal(15,2)) AS budget""",
                "cast(null as bigint) AS manager_id",
                "r_name AS location",
            )
        )

    @property
    def positions(self) -> DataFrame:
        # The eight levels in order.
        levels = "array('trainee','junior','middle','senior','lead','manager','director','executive')"
        return (
            self.base("part")
            .select("p_brand")
            .distinct()
            .selectExpr("p_brand", "cast(substr(p_brand, 7) as int) AS b")
            .selectExpr(
                "cast(b as bigint) AS position_id",
                "p_brand AS position_title",
                f"element_at({levels}, b % 8 + 1) AS position_level",
                "cast(20000 + 2000 * b as decimal(10,2)) AS base_salary_min",
                "cast(60000 + 2000 * b as decimal(10,2)) AS base_salary_max",
            )
        )

    @property
    def employees(self) -> DataFrame:
        return (
            self.base("customer")
            .withColumnRenamed("c_custkey", "k")
            .selectExpr(
                "*",
                "cast(k + 1 as bigint) AS employee_id",
                "substr(c_name, 10) AS last_name",
                "date_add(DATE'1990-01-01', cast((k * 37) % 3465 as int)) AS hire_date",
            )
            .selectExpr(
                "employee_id",
                "c_mktsegment AS first_name",
                "last_name",
                "lower(c_mktsegment) || '.' || last_name || '@company.com' AS email",
                "'+7' || lpad(cast(k % 1200 as string), 10, '0') AS phone",
                "hire_date",
                "cast(30000 + c_acctbal * 10 as decimal(12,2)) AS salary",
                "cast(c_nationkey + 1 as bigint) AS department_id",
                "cast((k * 7) % 25 + 1 as bigint) AS position_id",
                "CASE WHEN k >= 5 THEN cast(floor((k - 5) / 6) + 1 as bigint) END AS manager_id",
                "date_add(DATE'1950-01-01', cast((k * 97) % 10000 as int)) AS birth_date",
                "k % 11 <> 10 AS is_active",
                """least(date_add(hire_date, cast((k * 53) % 2000 as int)), DATE'1999-06-30')
                   AS updated_at""",
            )
        )

    @property
    def projects(self) -> DataFrame:
        # Project status by key.
        statuses = "array('planning','active','active','on_hold','completed','cancelled')"
        return (
            self.base("supplier")
            .selectExpr(
                "*",
                "s_suppkey AS s",
                "date_add(DATE'1996-01-01', cast((s_suppkey * 41) % 1200 as int)) AS start_date",
            )
            .selectExpr(
                "cast(s + 1 as bigint) AS project_id",
                "s_name AS project_name",
                "'Работы для ' || s_name || ', площадка ' || cast(s_nationkey as string) AS description",
                "cast(s_nationkey + 1 as bigint) AS department_id",
                "start_date",
                """CASE WHEN s % 5 = 0 THEN null WHEN s % 17 = 3 THEN start_date
                   ELSE date_add(start_date, cast((s * 83) % 950 as int)) END AS end_date""",
                "cast(500000 + s_acctbal * 100 as decimal(15,2)) AS budget",
                f"element_at({statuses}, cast(s % 6 + 1 as int)) AS status",
                "cast(s + 1 as bigint) AS project_manager_id",
            )
        )

    @property
    def employee_projects(self) -> DataFrame:
        lines = self.base("lineitem")
        orders = self.base("orders").select("o_orderkey", "o_custkey")
        return (
            lines.join(orders, lines.l_orderkey == orders.o_orderkey)
            .groupBy("o_custkey", "l_suppkey")
            .agg(
                F.max("l_linestatus").alias("line_status"),
                F.min("l_quantity").alias("quantity"),
                F.min("l_shipdate").alias("first_ship"),
                F.max("l_shipdate").alias("last_ship"),
                F.min("l_linenumber").alias("line"),
                F.min("l_extendedprice").alias("price"),
            )
            .selectExpr(
                "cast(o_custkey + 1 as bigint) AS employee_id",
                "cast(l_suppkey + 1 as bigint) AS project_id",
                "CASE WHEN line_status = 'O' THEN 'lead' ELSE 'member' END AS role_in_project",
                "cast(quantity * 2 as int) AS participation_percentage",
                "cast(first_ship as date) AS start_date",
                "CASE WHEN line % 3 = 0 THEN cast(last_ship as date) END AS end_date",
                "CASE WHEN line % 2 = 0 THEN cast(floor(price / 1000) as decimal(10,2)) END AS hourly_rate",
            )
        )

    @property
    def salary_history(self) -> DataFrame:
        return (
            self.base("orders")
            .selectExpr(
                "cast(o_orderkey + 1 as bigint) AS salary_change_id",
                "cast(o_custkey + 1 as bigint) AS employee_id",
                "cast(floor(o_totalprice / 10) as decimal(12,2)) AS old_salary",
                """cast(floor(o_totalprice / 10)
                        + floor(o_totalprice * (1 + o_orderkey % 15) / 1000) as decimal(12,2))
                   AS new_salary""",
                "add_months(cast(o_orderdate as date), -36) AS change_date",
                "o_orderpriority AS change_reason",
                "cast(o_orderkey % 5 + 1 as bigint) AS changed_by",
            )
        )

    @property
    def vacations(self) -> DataFrame:
        # Types and statuses by key.
        types = "array('annual','sick','maternity','unpaid','other')"
        statuses = "array('requested','approved','taken','rejected','cancelled')"
        # Dealt by order once, the lines are grouped and meet their orders without being shuffled again.
        lines = (
            self.base("lineitem")
            .select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_partkey", "l_suppkey", "l_returnflag")
            .repartition("l_orderkey")
            .groupBy("l_orderkey", "l_linenumber")
            .agg(
                F.min("l_shipdate").alias("ship"),
                F.min("l_quantity").alias("quantity"),
                F.min("l_partkey").alias("part"),
                F.min("l_suppkey").alias("supp"),
                F.max("l_returnflag").alias("flag"),
            )
        )
        orders = self.base("orders").select("o_orderkey", "o_custkey")
        return (
            lines.join(orders, lines.l_orderkey == orders.o_orderkey)
            .withColumn("start_date", F.expr("cast(ship as date)"))
            .withColumn("end_date", F.expr("date_add(start_date, cast(quantity + 14 as int))"))
            .selectExpr(
                "cast(l_orderkey * 10 + l_linenumber as bigint) AS vacation_id",
                "cast(o_custkey + 1 as bigint) AS employee_id",
                f"element_at({types}, l_linenumber % 5 + 1) AS vacation_type",
                "start_date",
                "end_date",
                "datediff(end_date, start_date) + 1 AS days_count",
                f"""CASE flag WHEN 'R' THEN element_at({statuses}, cast(part % 5 + 1 as int))
                    WHEN 'A' THEN 'taken' ELSE 'requested' END AS status""",
                "cast(supp + 1 as bigint) AS approved_by",
            )
        )

    @property
    def skills(self) -> DataFrame:
        return (
            self.base("part")
            .groupBy(F.col("p_name").alias("skill_name"))
            .agg(
                F.min("p_type").alias("category"),
                (F.min("p_partkey") + 1).cast("bigint").alias("skill_id"),
            )
        )

    @property
    def employee_skills(self) -> DataFrame:
        lines = self.base("lineitem")
        orders = self.base("orders").select("o_orderkey", "o_custkey")
        parts = (
            self.base("part")
            .select("p_partkey", F.col("p_name").alias("skill_name"))
            .join(self.skills.select("skill_name", "skill_id"), "skill_name")
        )
        return (
            lines.join(parts, lines.l_partkey == parts.p_partkey)
            .join(orders, lines.l_orderkey == orders.o_orderkey)
            .groupBy("o_custkey", "skill_id")
            .agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("discount"))
            .selectExpr(
                "cast(o_custkey + 1 as bigint) AS employee_id",
                "skill_id",
                """CASE WHEN q >= 45 THEN 'expert' WHEN q >= 30 THEN 'advanced'
                   WHEN q >= 15 THEN 'intermediate' ELSE 'beginner' END AS proficiency_level""",
                "discount >= 0.08 AS certified",
            )
        )

    @property
    def before(self) -> DataFrame:
        """Employees at the first of two snapshots."""
        return self.employees

    @property
    def after(self) -> DataFrame:
        """Employees at the second snapshot, with the day each row last changed.

        Some have left and come back under a new key.
        """
        return (
            self.employees.withColumn(
                "employee_id",
                F.expr(
                    """CASE WHEN employee_id % 50 = 0 THEN employee_id + 1000000000
                       ELSE employee_id END"""
                ),
            )
            .withColumn(
                "salary",
                F.expr(
                    """cast(CASE WHEN employee_id % 9 = 0 THEN round(salary * 1.05, 2)
                       WHEN employee_id % 31 = 0 THEN round(salary * 0.95, 2)
                       ELSE salary END as decimal(12,2))"""
                ),
            )
            .withColumn(
                "department_id",
                F.expr(
                    """CASE WHEN employee_id % 23 = 0 THEN department_id % 25 + 1
                       ELSE department_id END"""
                ),
            )
            .withColumn(
                "position_id",
                F.expr(
                    """CASE WHEN employee_id % 29 = 0 THEN position_id % 25 + 1
                       ELSE position_id END"""
                ),
            )
            .withColumn("changed_on", F.expr("date_sub(DATE'1999-06-30', cast(employee_id % 17 as int))"))
        )

    @property
    def cyclic(self) -> DataFrame:
        """Employees with reporting loops: one of two, one of three, one of itself."""
        return self.employees.withColumn(
            "manager_id",
            F.expr(
                """CASE employee_id WHEN 2 THEN 13 WHEN 3 THEN 19 WHEN 5 THEN 5
                   WHEN 4 THEN 999999999 ELSE manager_id END"""
            ),
        )

    def change_columns(self, events: DataFrame) -> DataFrame:
        """Change records out of the event table, batch or stream."""
        return events.selectExpr(
            "event_id AS change_id",
            "cast(ts as timestamp) AS changed_at",
            "cast(user_id + 1 as bigint) AS employee_id",
            """CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE'
               ELSE 'UPDATE' END AS operation""",
            "cast(30000 + value * 100 as decimal(12,2)) AS old_salary",
            "cast(30000 + value * 100 * (1 + (event_id % 3) * 0.1D) as decimal(12,2)) AS new_salary",
        )

    @property
    def changes(self) -> DataFrame:
        return self.change_columns(self.base("events"))
