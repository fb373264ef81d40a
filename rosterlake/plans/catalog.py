"""Every query by name: ``name -> callable(spark, folder) -> DataFrame``.

Queries run the operators over the workforce tables derived from the driver's
tables. Results are made plain for comparison: decimals become doubles of two
digits, lists become text.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType

from ..functions import payroll
from ..functions.expressions import asc, desc
from ..operators import change_checks, changes, guards, hierarchy, listing, pages, patches, quality, raises
from ..operators import reports, snapshots, staffing
from ..sources import intake, tables
from ..sources.fixtures import AS_OF, BASE_SCHEMAS, Fixtures
from ..sources.scratch import scratch_folder, write_and_read
from ..streaming import feeds

YEAR_AGO = date(1998, 6, 30)
MIDNIGHT = datetime(1999, 6, 30)
RECENT = datetime(2024, 1, 15)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(make: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    """Register a query under the name of its function."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(make(Fixtures(spark, folder)))

    run.__name__ = make.__name__
    QUERIES[make.__name__] = run
    return make


def plain(df: DataFrame) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DecimalType):
            if field.dataType.scale > 2:
                column = F.round(column, 2)
            column = column.cast("double")
        elif isinstance(field.dataType, ArrayType):
            column = F.array_join(column, ", ")
        columns.append(column.alias(field.name))
    return df.select(*columns)


# Sources and sinks


@query
def i0_load_tables(f: Fixtures) -> DataFrame:
    folder = scratch_folder(f.spark, "tables")
    tables.save({name: getattr(f, name) for name in tables.SCHEMAS if name != "audit_log"}, folder)
    tables.save({"audit_log": _audit(f)}, folder)
    return listing.table_counts(tables.load(f.spark, folder))


def _csv_lines(f: Fixtures) -> DataFrame:
    """Customers as an import file with missing, malformed and repeated values."""
    folder = scratch_folder(f.spark, "csv")
    (
        f.employees.withColumn("k", F.col("employee_id") - 1)
        .orderBy("employee_id")
        .selectExpr(
            "CASE WHEN k % 29 = 0 THEN '' ELSE first_name END AS first_name",
            "last_name",
            """CASE WHEN k % 13 = 0 THEN '' WHEN k % 17 = 0 THEN replace(email, '@', ' at ')
               WHEN k % 19 = 0 THEN 'shared.' || cast(k % 3 as string) || '@company.com'
               WHEN k % 23 = 0 THEN email ELSE 'new.' || email END AS email""",
            "CASE WHEN k % 31 = 0 THEN '' ELSE cast(hire_date as string) END AS hire_date",
            """CASE WHEN k % 37 = 0 THEN 'much' WHEN k % 7 = 0 THEN ''
               ELSE cast(salary - 31000 as string) END AS salary""",
            "CASE WHEN k % 41 = 0 THEN '99' ELSE cast(department_id as string) END AS department_id",
            "cast(position_id as string) AS position_id",
            "coalesce(cast(manager_id as string), 'NA') AS manager_id",
        )
        .write.option("header", True)
        .csv(folder)
    )
    return intake.read_numbered_csv(f.spark, folder)


def _import(f: Fixtures) -> intake.Import:
    return intake.import_employees(_csv_lines(f), f.employees, f.departments, f.positions, AS_OF)


@query
def i1_import_accepted(f: Fixtures) -> DataFrame:
    return _import(f).accepted


@query
def i1_import_rejected(f: Fixtures) -> DataFrame:
    return _import(f).rejected.select("row", "error")


@query
def i1_import_summary(f: Fixtures) -> DataFrame:
    return _import(f).summary


@query
def i2_append_new(f: Fixtures) -> DataFrame:
    return tables.append_new(f.skills, _offered_skills(f), "skill_name", "skill_id")


def _offered_skills(f: Fixtures) -> DataFrame:
    """Kinds of parts as new skills, each by many rows, some without a name."""
    kinds = f.base("part").selectExpr(
        "CASE WHEN p_partkey % 50 <> 0 THEN p_type END AS skill_name",
        "p_brand AS category",
        "cast(p_partkey + 1000000 as bigint) AS skill_id",
    )
    return kinds.unionByName(f.skills)


@query
def i2_refused(f: Fixtures) -> DataFrame:
    _, refused = tables.split_new(f.skills, _offered_skills(f), "skill_name", "skill_id")
    return refused.groupBy("refused").agg(F.count("*").alias("rows"))


@query
def i3_sample_rows(f: Fixtures) -> DataFrame:
    return tables.sample_rows(
        f.employees.select("employee_id", "last_name"), "employee_id", 100, seed=7
    )


def _moved_out(f: Fixtures) -> DataFrame:
    """Employees after department 7 moved into department 8, which leaves one empty."""
    return f.employees.withColumn(
        "department_id", F.expr("CASE WHEN department_id = 7 THEN 8 ELSE department_id END")
    )


@query
def i4_report_records(f: Fixtures) -> DataFrame:
    report = reports.department_payroll(f.departments, _moved_out(f))
    return tables.to_records(
        report.select("department_id", "department_name", "employee_count", "total_salary")
    )


# Listings and lookups


@query
def q1_list_employees(f: Fixtures) -> DataFrame:
    return listing.list_employees(f.employees, department_id=3, skip=10, limit=25)


@query
def q1_page_summary(f: Fixtures) -> DataFrame:
    return listing.page_summary(f.employees.filter("department_id = 3"), skip=10, limit=25)


@query
def q2_get_employee(f: Fixtures) -> DataFrame:
    return listing.get_employee(f.employees, 42)


@query
def q3_list_departments(f: Fixtures) -> DataFrame:
    return listing.list_departments(f.departments, f.employees)


@query
def q4_list_positions(f: Fixtures) -> DataFrame:
    return listing.list_positions(f.positions, skip=5, limit=10)


def _audit(f: Fixtures) -> DataFrame:
    return feeds.audit_rows(f.changes)


def _readable(column: str):
    """A point in time as text, the same in every zone."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query
def q5_list_audit(f: Fixtures) -> DataFrame:
    page = listing.list_audit(
        _audit(f),
        table_name="employees",
        operation="INSERT",
        skip=10,
        limit=50,
        tie_break=["record_id", "new_values"],
    )
    return page.withColumn("changed_at", _readable("changed_at"))


@query
def s3_deep_page(f: Fixtures) -> DataFrame:
    """A page far down the whole assignment list, read from ranges."""
    keys = [desc("hourly_rate"), asc("project_id"), asc("employee_id")]
    page = pages.deep_page(f.employee_projects, 2000, 100, *keys, ranges=16)
    return page.select("employee_id", "project_id", "hourly_rate")


@query
def s3_page_after(f: Fixtures) -> DataFrame:
    """The people who follow a salary and key in the salary list."""
    keys = [("salary", True), ("employee_id", False)]
    chosen = pages.page_after(f.employees, keys, [Decimal("120000.00"), 0], 100)
    return chosen.select("employee_id", "salary")


@query
def q6_department_employees(f: Fixtures) -> DataFrame:
    return listing.department_employees(f.employees, f.positions, 3)


@query
def q7_search_employees(f: Fixtures) -> DataFrame:
    return listing.search_employees(
        f.employees, f.departments, f.positions, f.employee_skills, f.skills
    )


@query
def q7_search_by_skill(f: Fixtures) -> DataFrame:
    return listing.search_employees(
        f.employees,
        f.departments,
        f.positions,
        f.employee_skills,
        f.skills,
        min_salary=50_000,
        max_salary=100_000,
        skill_ids=[1, 2, 3, 4, 5, 6, 7, 8],
        hired_from=date(1993, 1, 1),
        hired_to=date(1998, 12, 31),
    )


@query
def q8_table_counts(f: Fixtures) -> DataFrame:
    names = [
        "departments",
        "positions",
        "employees",
        "skills",
        "projects",
        "employee_projects",
        "employee_skills",
    ]
    return listing.table_counts({n: getattr(f, n) for n in names})


@query
def q9_filtered_catalog(f: Fixtures) -> DataFrame:
    part, line = f.base("part"), f.base("lineitem")
    return listing.filtered_catalog(
        part,
        line,
        part.p_partkey == line.l_partkey,
        "p_name",
        "ring",
        "p_retailprice",
        900.0,
        1000.0,
        "p_type",
        "ECONOMY",
    ).select("p_partkey", "p_name", "p_retailprice", "l_orderkey", "l_linenumber", "l_quantity")


@query
def q10_filtered_orders(f: Fixtures) -> DataFrame:
    orders, customer = f.base("orders"), f.base("customer")
    return listing.filtered_orders(
        orders,
        customer,
        orders.o_custkey == customer.c_custkey,
        "o_orderstatus",
        "F",
        "o_orderdate",
        date(1997, 1, 1),
        date(1997, 12, 31),
        "o_orderkey",
    ).select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice", "c_name")


@query
def q11_open_sets(f: Fixtures) -> DataFrame:
    def keys(name: str, table: DataFrame, key: str, other=None) -> DataFrame:
        return listing.open_set(name, table, RECENT).select(
            F.lit(name).alias("open_set"),
            F.col(key).cast("long").alias("id"),
            (F.col(other) if other else F.lit(None)).cast("long").alias("other_id"),
        )

    audit = _audit(f).withColumn("digits", F.date_format("changed_at", "yyMMddHHmmssSSSSSS"))
    return (
        keys("active_employees", f.employees, "employee_id")
        .unionByName(keys("open_projects", f.projects, "project_id"))
        .unionByName(keys("approved_vacations", f.vacations, "vacation_id"))
        .unionByName(keys("recent_audit", audit, "record_id", "digits"))
        .unionByName(keys("open_assignments", f.employee_projects, "employee_id", "project_id"))
        .unionByName(keys("certified_skills", f.employee_skills, "employee_id", "skill_id"))
    )


@query
def q12_token_search(f: Fixtures) -> DataFrame:
    found = listing.token_search(
        f.projects, ["description"], ["работы", "для", "площадка", "15"]
    )
    return found.select("project_id", "description")



@query
def s2_second_highest_paid(f: Fixtures) -> DataFrame:
    return listing.second_highest_paid(
        f.employees.select("employee_id", "last_name", "department_id", "salary")
    )


# Views and reports


@query
def v1_employee_details(f: Fixtures) -> DataFrame:
    return reports.employee_details(f.employees, f.departments, f.positions, AS_OF)


@query
def v2_department_salary_report(f: Fixtures) -> DataFrame:
    return reports.department_salary_report(f.departments, f.employees, f.positions)


@query
def v3_employee_hierarchy(f: Fixtures) -> DataFrame:
    return hierarchy.employee_hierarchy(f.employees, f.departments, f.positions)


@query
def v4_project_resource_report(f: Fixtures) -> DataFrame:
    return reports.project_resource_report(
        f.projects, f.employee_projects, f.employees, f.departments, AS_OF
    )


@query
def v5_skill_analytics(f: Fixtures) -> DataFrame:
    return reports.skill_analytics(f.skills, f.employee_skills, f.employees, f.departments)


@query
def v6_vacation_calendar(f: Fixtures) -> DataFrame:
    return reports.vacation_calendar(
        f.vacations, f.employees, f.departments, f.positions, AS_OF
    )


@query
def v7_salary_change_analysis(f: Fixtures) -> DataFrame:
    return reports.salary_change_analysis(f.salary_history, f.employees, f.departments)


@query
def v8_hr_dashboard(f: Fixtures) -> DataFrame:
    return reports.hr_dashboard(f.employees, f.departments, f.projects, f.vacations, AS_OF)


@query
def v9_employee_info(f: Fixtures) -> DataFrame:
    return reports.employee_info(f.employees, f.departments)


@query
def v10_department_budget(f: Fixtures) -> DataFrame:
    return reports.department_budget(f.departments, f.employees)


@query
def r1_subordinates(f: Fixtures) -> DataFrame:
    return hierarchy.subordinates(f.employees, 2).select(
        "employee_id", "first_name", "last_name", "manager_id", "is_active", "level"
    )


@query
def r2_employee_manager_list(f: Fixtures) -> DataFrame:
    return reports.employee_manager_list(f.employees, f.departments, f.positions)


@query
def r3_hierarchy_sample(f: Fixtures) -> DataFrame:
    return reports.hierarchy_sample(f.employees, f.departments, f.positions)


@query
def r4_department_statistics(f: Fixtures) -> DataFrame:
    return reports.department_statistics(f.departments, f.employees)


@query
def r5_department_payroll(f: Fixtures) -> DataFrame:
    return reports.department_payroll(f.departments, _moved_out(f))


@query
def r6_employee_statistics(f: Fixtures) -> DataFrame:
    return reports.employee_statistics(f.employees, f.departments)


@query
def r7_project_load(f: Fixtures) -> DataFrame:
    return reports.project_load(f.projects, f.employee_projects)


# Functions


@query
def f1_department_fund(f: Fixtures) -> DataFrame:
    return payroll.department_fund(f.departments, f.employees)


@query
def f2_check_hire(f: Fixtures) -> DataFrame:
    candidates = f.employees.selectExpr(
        "employee_id AS candidate_id",
        "CASE WHEN employee_id % 30 = 0 THEN 99 ELSE department_id END AS department_id",
        "cast(salary * 12 as decimal(12,2)) AS salary",
    )
    return payroll.check_hire(candidates, f.departments, f.employees)


@query
def f3_raise_salaries(f: Fixtures) -> DataFrame:
    _, raised = payroll.raise_salaries(f.employees, 3, Decimal("7.50"))
    return raised


@query
def f3_raise_job(f: Fixtures) -> DataFrame:
    """History of the raises that went through, and whom the others would have concerned."""
    outcomes = None
    # A third of the budgets is far too small for its staff, so some raises are refused.
    departments = f.departments.withColumn(
        "budget", F.expr("cast(CASE WHEN department_id % 3 = 0 THEN budget / 10000 ELSE budget * 100 END as decimal(15,2))")
    )
    for department in (3, 4, 5, 6):
        job = raises.raise_department(
            f.employees, departments, department, Decimal("7.50"), MIDNIGHT
        )
        done = job.history.select(
            "employee_id", "old_salary", "new_salary", "change_reason", F.lit("raised").alias("outcome")
        )
        held = job.refused.select(
            "employee_id",
            *[F.lit(None).cast("decimal(12,2)").alias(c) for c in ("old_salary", "new_salary")],
            F.lit(None).cast("string").alias("change_reason"),
            F.lit("refused").alias("outcome"),
        )
        both = done.unionByName(held)
        outcomes = both if outcomes is None else outcomes.unionByName(both)
    return outcomes


@query
def f4_manager_subordinates(f: Fixtures) -> DataFrame:
    return hierarchy.manager_subordinates(f.employees, f.positions, 1)


@query
def f5_project_cost(f: Fixtures) -> DataFrame:
    return payroll.project_cost(f.projects, f.employee_projects, f.employees, AS_OF)


@query
def f6a_new_hires(f: Fixtures) -> DataFrame:
    return payroll.new_hires(f.employees, YEAR_AGO, AS_OF)


@query
def f6b_avg_hire_salary(f: Fixtures) -> DataFrame:
    return payroll.avg_hire_salary(f.employees, YEAR_AGO, AS_OF)


@query
def f6c_turnover(f: Fixtures) -> DataFrame:
    return payroll.turnover(f.employees, YEAR_AGO, AS_OF)


@query
def f6d_department_utilization(f: Fixtures) -> DataFrame:
    return payroll.department_utilization(f.departments, f.employees)


@query
def f6_hr_statistics(f: Fixtures) -> DataFrame:
    return payroll.hr_statistics(f.employees, f.departments, AS_OF)


@query
def f8_vacation_days(f: Fixtures) -> DataFrame:
    return payroll.vacation_days(f.vacations, AS_OF)


@query
def f9_tenure(f: Fixtures) -> DataFrame:
    return payroll.tenure(f.employees, AS_OF)


# Change tracking


@query
def t1_audit_diff(f: Fixtures) -> DataFrame:
    audit = changes.audit_diff(f.before, f.after.drop("changed_on"), MIDNIGHT)
    return audit.withColumn("changed_at", F.to_date("changed_at"))


@query
def t1_few_changes(f: Fixtures) -> DataFrame:
    audit = changes.audit_diff(f.before, f.after.drop("changed_on"), MIDNIGHT, few_changes=True)
    return audit.withColumn("changed_at", F.to_date("changed_at"))


@query
def t2_few_changes(f: Fixtures) -> DataFrame:
    kept, rejected = changes.salary_changes(f.before, f.after, AS_OF, few_changes=True)
    return kept.withColumn("outcome", F.lit("kept")).unionByName(
        rejected.withColumn("outcome", F.lit("rejected"))
    )


@query
def t3_few_changes(f: Fixtures) -> DataFrame:
    touched = changes.touch(
        f.before, f.after.drop("changed_on"), F.lit(date(1999, 7, 1)), few_changes=True
    )
    return touched.select("employee_id", "salary", "department_id", "position_id", "updated_at")


@query
def t2_salary_changes(f: Fixtures) -> DataFrame:
    kept, rejected = changes.salary_changes(f.before, f.after, AS_OF)
    return kept.withColumn("outcome", F.lit("kept")).unionByName(
        rejected.withColumn("outcome", F.lit("rejected"))
    )


@query
def t3_touch(f: Fixtures) -> DataFrame:
    touched = changes.touch(
        f.before, f.after.drop("changed_on"), F.lit(date(1999, 7, 1))
    )
    return touched.select("employee_id", "salary", "department_id", "position_id", "updated_at")


@query
def t4_reassign_department_heads(f: Fixtures) -> DataFrame:
    departments = f.departments.withColumn("updated_at", F.lit(YEAR_AGO))
    headed = changes.reassign_department_heads(
        f.before, f.after, f.positions, departments, at=F.lit(AS_OF)
    )
    return headed.select("department_id", "department_name", "manager_id", "updated_at", "reassigned")


@query
def t5_hierarchy_violations(f: Fixtures) -> DataFrame:
    return hierarchy.hierarchy_violations(f.cyclic)


@query
def t6_vacation_days_check(f: Fixtures) -> DataFrame:
    kept, rejected = changes.vacation_days_check(f.vacations.drop("days_count"))
    return kept.withColumn("outcome", F.lit("kept")).unionByName(
        rejected.withColumn("outcome", F.lit("rejected"))
    ).select("vacation_id", "employee_id", "start_date", "end_date", "days_count", "outcome")


@query
def t7_project_status(f: Fixtures) -> DataFrame:
    return changes.project_status(f.projects, AS_OF).select(
        "project_id", "start_date", "end_date", "status"
    )


@query
def t7b_budget_violations(f: Fixtures) -> DataFrame:
    return changes.budget_violations(f.employees, f.departments)


@query
def t7c_department_stats_after(f: Fixtures) -> DataFrame:
    return changes.department_stats_after(f.before, f.after)


@query
def t8_fill_department_heads(f: Fixtures) -> DataFrame:
    return staffing.fill_department_heads(f.departments, f.employees)


@query
def t9_fill_managers(f: Fixtures) -> DataFrame:
    heads = write_and_read(
        staffing.fill_department_heads(f.departments, f.employees), "heads"
    )
    gaps = f.employees.withColumn(
        "manager_id", F.expr("CASE WHEN employee_id % 3 <> 0 THEN manager_id END")
    )
    return staffing.fill_managers(gaps, heads).select("employee_id", "department_id", "manager_id")


@query
def t9b_assign_positions(f: Fixtures) -> DataFrame:
    # Department names that the rules tell apart.
    names = (
        "array('Руководство','ИТ','Финансы','Разработка','Продажи','Бухгалтерия','Маркетинг',"
        "'Кадры','Поддержка','Склад')"
    )
    departments = f.departments.withColumn(
        "department_name", F.expr(f"element_at({names}, cast(department_id % 10 + 1 as int))")
    )
    staff = f.employees.withColumn(
        "position_id", F.expr("CASE WHEN employee_id % 4 = 0 THEN position_id END")
    ).withColumn("salary", F.expr("cast(salary * 2 as decimal(12,2))"))
    return staffing.assign_positions(staff, departments).select(
        "employee_id", "salary", "position_id"
    )


@query
def t10_assign_skills(f: Fixtures) -> DataFrame:
    return staffing.assign_skills(
        f.employees,
        f.departments,
        f.skills,
        f.employee_skills,
        ["ECONOMY", "PROMO"],
        ["_1", "_20"],
        per_employee=5,
    )


@query
def t11_assign_projects(f: Fixtures) -> DataFrame:
    return staffing.assign_projects(
        f.employees,
        f.projects,
        f.employee_projects,
        percentage=(70 + F.pmod(F.col("employee_id") * 7 + F.col("project_id") * 13, F.lit(31))),
        starts=F.date_add(
            "start_date",
            F.pmod(F.col("employee_id") + F.col("project_id"), F.lit(30)).cast("int"),
        ),
        per_employee=2,
    )


@query
def t12_apply_updates(f: Fixtures) -> DataFrame:
    patches = f.employees.selectExpr(
        "CASE WHEN employee_id % 90 = 0 THEN employee_id + 100000000 ELSE employee_id END AS employee_id",
        "explode(array(1, 2)) AS patch_no",
        "phone",
        "cast(salary * 2 as decimal(12,2)) AS salary",
        "department_id % 25 + 1 AS department_id",
    ).selectExpr(
        "employee_id",
        "patch_no",
        "CASE WHEN employee_id % 12 = 0 THEN phone || '0' END AS phone",
        "cast(salary + patch_no as decimal(12,2)) AS salary",
        "department_id",
        """CASE WHEN employee_id % 6 <> 0 THEN cast(array() AS array<string>)
           WHEN patch_no = 1 THEN array('phone', 'salary')
           WHEN employee_id % 18 = 0 THEN array('salary', 'department_id')
           ELSE array('department_id') END AS fields""",
    )
    updated, unknown = changes.apply_updates(f.employees, patches)
    return (
        updated.select("employee_id", "phone", "salary", "department_id")
        .withColumn("outcome", F.lit("employee"))
        .unionByName(
            unknown.select("employee_id", "phone", "salary", "department_id").withColumn(
                "outcome", F.lit("unknown")
            )
        )
    )


def _delete(f: Fixtures) -> tuple[dict[str, DataFrame], DataFrame]:
    names = [
        "employees",
        "projects",
        "employee_projects",
        "salary_history",
        "vacations",
        "employee_skills",
    ]
    ids = f.employees.filter("NOT is_active").select("employee_id")
    log = f.changes.selectExpr("change_id AS log_id", "employee_id AS changed_by")
    return changes.delete_employees(ids, {n: getattr(f, n) for n in names} | {"audit_log": log})


@query
def t13_delete_employees(f: Fixtures) -> DataFrame:
    left, _ = _delete(f)
    keys = {
        "employees": ("employee_id", "manager_id"),
        "employee_projects": ("employee_id", "project_id"),
        "salary_history": ("salary_change_id", "employee_id"),
        "vacations": ("vacation_id", "approved_by"),
        "employee_skills": ("employee_id", "skill_id"),
        "audit_log": ("log_id", "changed_by"),
    }
    result = None
    for name, (first, second) in keys.items():
        part = left[name].select(
            F.lit(name).alias("table_name"),
            F.col(first).alias("id"),
            F.col(second).alias("other_id"),
        )
        result = part if result is None else result.unionByName(part)
    return result


@query
def t12_checked_updates(f: Fixtures) -> DataFrame:
    # Everyone has a patch; most ask for some values they have already.
    beside = f.employees.selectExpr("employee_id - 1 AS employee_id", "email AS next_email")
    last = f.employees.agg(F.max("employee_id")).first()[0] or 0
    asked = guards.join_by_key(f.employees, beside, "employee_id", "left").selectExpr(
        "employee_id",
        "1 AS patch_no",
        """cast(CASE WHEN employee_id % 12 = 0 THEN -1 WHEN employee_id % 6 = 0 THEN salary + 1
           WHEN employee_id % 6 = 1 THEN salary + 30000 ELSE salary END as decimal(12,2)) AS salary""",
        """cast(CASE WHEN employee_id % 18 = 0 THEN 99 WHEN employee_id % 6 = 0 THEN 3
           ELSE department_id END as bigint) AS department_id""",
        """CASE WHEN employee_id % 30 = 0 THEN 'same@company.com' WHEN employee_id % 6 = 0 THEN 'p.' || email
           WHEN employee_id % 6 >= 4 THEN coalesce(next_email, email) ELSE email END AS email""",
        f"""CASE WHEN employee_id % 10 = 1 AND 6 * employee_id <= {last} THEN 6 * employee_id
           WHEN employee_id % 10 = 2 THEN employee_id + 1 WHEN employee_id % 10 = 3 THEN employee_id - 1
           ELSE manager_id END AS manager_id""",
        "array('email', 'salary', 'department_id', 'manager_id') AS fields",
    )
    job = patches.apply_checked_updates(f.employees, asked, f.departments, f.positions, AS_OF)
    return guards.join_by_key(job.employees, job.refused, "employee_id", "left").select(
        "employee_id", "email", "salary", "department_id", "manager_id", F.array_join("broken", ", ").alias("broken")
    )


@query
def t13_blocked_deletes(f: Fixtures) -> DataFrame:
    return _delete(f)[1]


@query
def t14_validate_new_employees(f: Fixtures) -> DataFrame:
    requests = f.employees.selectExpr(
        "employee_id AS request_no",
        "first_name",
        """CASE WHEN employee_id % 5 = 0 THEN email
           WHEN employee_id % 4 = 0 THEN 'same.' || cast(employee_id % 7 as string) || '@company.com'
           ELSE 'new.' || email END AS email""",
        "CASE WHEN employee_id % 8 = 0 THEN 77 WHEN employee_id % 9 = 0 THEN 0 ELSE department_id END AS department_id",
        "CASE WHEN employee_id % 11 = 0 THEN manager_id + 100000000 ELSE manager_id END AS manager_id",
        "salary",
    )
    return intake.validate_new_employees(requests, f.employees, f.departments)


@query
def t15_create_departments(f: Fixtures) -> DataFrame:
    requests = f.base("supplier").selectExpr(
        "s_suppkey + 101 AS department_id",
        """CASE WHEN s_suppkey % 4 = 0 THEN 'NATION_' || cast(s_nationkey as string)
           ELSE s_name END AS department_name""",
        "cast(s_acctbal + 2000 as decimal(15,2)) AS budget",
        "cast(null as string) AS location",
        "cast(null as bigint) AS manager_id",
    )
    created, _ = intake.create_departments(requests, f.departments)
    return created


# Data quality


class Dirty:
    """Fixture tables with broken values at known keys."""

    def __init__(self, f: Fixtures):
        self.tables = {
            "departments": f.departments.selectExpr(
                "department_id",
                "CASE WHEN department_id % 9 = 0 THEN 'NATION_0' ELSE department_name END AS department_name",
                "cast(CASE WHEN department_id % 10 = 0 THEN -1 ELSE budget END as decimal(15,2)) AS budget",
            ),
            "positions": f.positions.selectExpr(
                "position_id",
                "CASE WHEN position_id > 20 THEN 'Brand' ELSE position_title END AS position_title",
                "CASE WHEN position_id % 6 = 0 THEN 'chief' ELSE position_level END AS position_level",
                "base_salary_min",
                "cast(CASE WHEN position_id % 7 = 0 THEN 1 ELSE base_salary_max END as decimal(10,2)) AS base_salary_max",
            ),
            "employees": f.employees.selectExpr(
                "employee_id",
                "CASE WHEN employee_id % 67 <> 0 THEN first_name END AS first_name",
                "last_name",
                """CASE WHEN employee_id % 43 = 0 THEN replace(email, '@', '#')
                   WHEN employee_id % 71 = 0 THEN 'twice@company.com' ELSE email END AS email""",
                "phone",
                "CASE WHEN employee_id % 53 = 0 THEN DATE'1999-07-15' ELSE hire_date END AS hire_date",
                "cast(CASE WHEN employee_id % 41 = 0 THEN -salary ELSE salary END as decimal(12,2)) AS salary",
                "CASE WHEN employee_id % 59 = 0 THEN 99 ELSE department_id END AS department_id",
                "position_id",
                "CASE WHEN employee_id % 61 = 0 THEN 999999999 ELSE manager_id END AS manager_id",
                "CASE WHEN employee_id % 47 = 0 THEN DATE'1985-01-01' ELSE birth_date END AS birth_date",
                "is_active",
            ),
            "projects": f.projects.selectExpr(
                "project_id",
                "project_name",
                "department_id",
                "start_date",
                "CASE WHEN project_id % 7 = 0 THEN date_sub(start_date, 1) ELSE end_date END AS end_date",
                "cast(CASE WHEN project_id % 11 = 0 THEN -1 ELSE budget END as decimal(15,2)) AS budget",
                "CASE WHEN project_id % 9 = 0 THEN 'unknown' ELSE status END AS status",
                "project_manager_id",
            ),
            "employee_projects": f.employee_projects.selectExpr(
                """CASE WHEN employee_id % 101 <> 0 THEN (employee_id - CASE WHEN employee_id % 103 = 0 THEN 1 ELSE 0 END)
                   * 1000000 + project_id END AS employee_project_id""",
                "employee_id",
                "project_id",
                "CASE WHEN employee_id % 107 = 0 THEN repeat('x', 101) ELSE role_in_project END AS role_in_project",
                "participation_percentage + CASE WHEN employee_id % 73 = 0 THEN 60 ELSE 0 END AS participation_percentage",
                "start_date",
                "end_date",
                "cast(CASE WHEN employee_id % 79 = 0 THEN -hourly_rate ELSE hourly_rate END as decimal(10,2)) AS hourly_rate",
            ),
            "salary_history": f.salary_history.selectExpr(
                "salary_change_id",
                "employee_id",
                "old_salary",
                "cast(CASE WHEN salary_change_id % 97 = 0 THEN old_salary - 1 ELSE new_salary END as decimal(12,2)) AS new_salary",
                "CASE WHEN salary_change_id % 89 = 0 THEN DATE'1999-08-01' ELSE change_date END AS change_date",
                "change_reason",
                "CASE WHEN salary_change_id % 83 = 0 THEN 888888888 ELSE changed_by END AS changed_by",
            ),
            "vacations": f.vacations.selectExpr(
                "vacation_id",
                "employee_id",
                "CASE WHEN vacation_id % 89 = 0 THEN 'holiday' ELSE vacation_type END AS vacation_type",
                "start_date",
                "CASE WHEN vacation_id % 83 = 0 THEN date_sub(start_date, 5) ELSE end_date END AS end_date",
                "CASE WHEN vacation_id % 79 = 0 THEN 'lost' ELSE status END AS status",
                "approved_by",
            ),
            "skills": f.skills.selectExpr(
                "skill_name",
                "category",
                "CASE WHEN skill_id % 10 = 0 THEN skill_id + 1000000000 ELSE skill_id END AS skill_id",
            ),
            "employee_skills": f.employee_skills.selectExpr(
                "employee_id - CASE WHEN employee_id % 10 = 0 THEN 1 ELSE 0 END AS employee_id",
                "skill_id",
                "CASE WHEN (employee_id + skill_id) % 83 = 0 THEN 'guru' ELSE proficiency_level END AS proficiency_level",
                "certified",
                "employee_id * 1000000 + skill_id AS employee_skill_id",
                "CASE WHEN (employee_id + skill_id) % 89 = 0 THEN DATE'1999-12-31' WHEN certified THEN DATE'1998-01-01' END AS certification_date",
            ),
            "audit_log": f.changes.selectExpr(
                "change_id AS log_id",
                "'employees' AS table_name",
                "employee_id AS record_id",
                "CASE WHEN change_id % 79 = 0 THEN 'CALCULATE' ELSE operation END AS operation_type",
                "employee_id AS changed_by",
            ),
        }


@query
def c_constraint_report(f: Fixtures) -> DataFrame:
    return quality.constraint_report(Dirty(f).tables, AS_OF)


@query
def c1_check_violations(f: Fixtures) -> DataFrame:
    dirty = Dirty(f).tables["employees"]
    return quality.check_violations("employees", dirty, AS_OF).select("employee_id", "broken")


@query
def c2_duplicate_keys(f: Fixtures) -> DataFrame:
    return quality.duplicate_keys(
        Dirty(f).tables["employee_skills"], ["employee_id", "skill_id"]
    )


@query
def c3_orphans(f: Fixtures) -> DataFrame:
    dirty = Dirty(f).tables
    return quality.orphans(dirty["employee_skills"], "skill_id", dirty["skills"], "skill_id")


@query
def c3_orphan_rows(f: Fixtures) -> DataFrame:
    dirty = Dirty(f).tables
    return quality.orphan_rows(
        dirty["employees"], "manager_id", dirty["employees"], "employee_id"
    ).select("employee_id", "manager_id")


@query
def c4_missing_values(f: Fixtures) -> DataFrame:
    report = quality.check_report("employees", Dirty(f).tables["employees"], AS_OF)
    return report.filter("constraint_name LIKE 'not null%'")


@query
def c5_partial_unique(f: Fixtures) -> DataFrame:
    return quality.duplicate_keys(f.employees.filter("phone IS NOT NULL"), ["phone"])


@query
def c5_open_assignments(f: Fixtures) -> DataFrame:
    """People with more than one open assignment to a project, where every line item is an assignment."""
    lines, orders = f.base("lineitem"), f.base("orders")
    opened = lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr(
        "o_custkey + 1 AS employee_id",
        "l_suppkey + 1 AS project_id",
        "CASE WHEN l_returnflag <> 'N' THEN l_shipdate END AS end_date",
    )
    return quality.duplicate_keys(opened.filter("end_date IS NULL"), ["employee_id", "project_id"])


def _next_tables(before: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The dirty tables after some rows went, came or changed."""
    after = dict(before)
    after["employees"] = before["employees"].selectExpr(
        "* EXCEPT (employee_id, email, salary)",
        "CASE WHEN employee_id % 50 = 0 THEN employee_id + 2000000000 ELSE employee_id END AS employee_id",
        "CASE WHEN employee_id % 19 = 0 THEN concat('moved.', cast(employee_id % 5 as string), '@x.org') ELSE email END AS email",
        "cast(CASE WHEN employee_id % 13 = 0 THEN -1 ELSE salary END as decimal(12,2)) AS salary",
    )
    after["departments"] = before["departments"].filter("department_id % 7 <> 0")
    return after


@query
def c_change_report(f: Fixtures) -> DataFrame:
    before = Dirty(f).tables
    after = _next_tables(before)
    moved = {
        table: snapshots.changed_rows(before[table], after[table], quality.PRIMARY_KEYS[table])
        for table in ("employees", "departments")
    }
    return change_checks.change_report(after, moved, AS_OF).filter("change <> 0")


@query
def c6_request_errors(f: Fixtures) -> DataFrame:
    dirty = Dirty(f).tables
    raises = f.employees.selectExpr(
        "employee_id", "cast(employee_id % 120 - 10 as decimal(5,2)) AS percent"
    )
    requests = {
        "employee": (dirty["employees"], "employee_id"),
        "department": (dirty["departments"], "department_id"),
        "position": (dirty["positions"], "position_id"),
        "project": (dirty["projects"], "project_id"),
        "vacation": (dirty["vacations"], "vacation_id"),
        "salary_change": (dirty["salary_history"], "salary_change_id"),
        "raise": (raises, "employee_id"),
    }
    result = None
    for kind, (rows, key) in requests.items():
        part = (
            quality.request_errors(kind, rows, AS_OF)
            .filter("size(errors) > 0")
            .select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "errors")
        )
        result = part if result is None else result.unionByName(part)
    return result


# Streams


def _feed(f: Fixtures) -> DataFrame:
    events = feeds.read_feed(f.spark, f.folder, "events.parquet", BASE_SCHEMAS["events"])
    return f.change_columns(events)


@query
def x1_stream_audit(f: Fixtures) -> DataFrame:
    audit = feeds.drain_once(_feed(f), feeds.audit_rows, "audit")
    return audit.withColumn("changed_at", _readable("changed_at"))


@query
def x2_stream_history(f: Fixtures) -> DataFrame:
    return feeds.drain_once(_feed(f), feeds.history_rows, "history")


@query
def x3_stream_department_figures(f: Fixtures) -> DataFrame:
    return feeds.stream_department_figures(_feed(f), f.employees, "figures")


@query
def x3_stream_department_movement(f: Fixtures) -> DataFrame:
    return feeds.stream_department_movement(_feed(f), f.employees, "movement")
