from datetime import date
from decimal import Decimal

from rosterlake import labels
from rosterlake.operators import quality
from rosterlake.session import partitions_for
from rosterlake.sources import intake, tables

AS_OF = date(2023, 2, 28)
HEADER = "email,first_name,last_name,hire_date,salary,department_id,position_id,manager_id\n"


def run(spark, make, folder, *files, **options):
    for name, text in files:
        (folder / name).write_text(text, encoding="utf-8")
    return intake.import_employees(
        intake.read_numbered_csv(spark, str(folder), **options),
        make("employees", {"employee_id": 1, "email": "old@x.org"}),
        make("departments", {"department_id": 1, "budget": None}),
        make("positions", {"position_id": 1}),
        AS_OF,
    )


def test_reasons_in_order(spark, make, tmp_path):
    rows = [
        "new@x.org,A,B,2020-01-01,10,1,1,",
        ",A,B,2020-01-01,10,1,1,",
        "a@x.org,nan,B,2020-01-01,10,1,1,",
        "nowhere,A,B,2020-01-01,-1,1,1,",
        "old@x.org,A,B,2020-01-01,-1,1,1,",
        "b@x.org,A,B,2020-01-01,-1,1,1,",
        "c@x.org,A,B,someday,10,1,1,",
        "d@x.org,A,B,2020-01-01,much,1,1,",
        "e@x.org,A,,2020-01-01,10,1,1,",
        "f@x.org,A,B,2020-01-01,10,7,1,",
        "g@x.org,A,B,2020-01-01,10,1,,",
        "h@x.org,A,B,2020-01-01,10,1,1,5",
        "i@x.org,A,B,2024-01-01,10,1,1,",
        "j@x,A,B,2020-01-01,10,1,1,",
        "k@x.org,A,B,,,1.0,1,1",
        "l@x.org,A,B,2020-01-01,1e40,1,1,",
    ]
    result = run(spark, make, tmp_path, ("in.csv", HEADER + "\n".join(rows) + "\n"))
    errors = {r.row: r.error for r in result.rejected.collect()}
    rule, value = labels.TABLE_RULE, labels.BAD_VALUE
    expected = {
        2: labels.MISSING_FIELDS,
        3: labels.MISSING_FIELDS,
        4: labels.BAD_EMAIL,
        5: "Email old@x.org уже существует",
        6: labels.NEGATIVE_SALARY,
        7: value,
        8: value,
        9: rule,
        10: rule,
        11: rule,
        12: rule,
        13: rule,
        14: rule,
    }
    expected[16] = value if errors[16].endswith(value) else rule
    assert errors == {k: f"Строка {k}: {v}" for k, v in expected.items()}
    accepted = {r.row_no: r for r in result.accepted.collect()}
    assert set(accepted) == {1, 15}
    assert accepted[15].hire_date == AS_OF
    assert accepted[15].salary == 0
    assert accepted[15].manager_id == 1
    assert tuple(result.summary.collect()[0]) == (2, 14, 16)


def test_rejected_row_does_not_take_the_email(spark, make, tmp_path):
    rows = [
        "a@x.org,A,B,2020-01-01,-5,1,1,",
        "a@x.org,A,B,2020-01-01,5,1,1,",
        "a@x.org,A,B,2020-01-01,-5,1,1,",
        "a@x.org,A,B,2020-01-01,6,1,1,",
    ]
    result = run(spark, make, tmp_path, ("in.csv", HEADER + "\n".join(rows)))
    assert [(r.row_no, r.salary) for r in result.accepted.collect()] == [(2, Decimal(5))]
    errors = {r.row: r.error for r in result.rejected.collect()}
    assert errors[1].endswith(labels.NEGATIVE_SALARY)
    assert errors[3].endswith("уже существует")
    assert errors[4].endswith("уже существует")


def test_rows_are_numbered_across_files_and_splits(spark, make, tmp_path):
    def part(start, n):
        return HEADER + "".join(
            f"u{i}@x.org,Имя{i},B,2020-01-01,{i},1,1,\n" for i in range(start, start + n)
        )

    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        result = run(
            spark, make, tmp_path, ("a.csv", part(1, 30)), ("b.csv", part(31, 400)), ("c.csv", part(431, 70))
        )
        accepted = result.accepted.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert len(accepted) == 500
    assert all(r.email == f"u{r.row_no}@x.org" for r in accepted)


def test_quoted_text_and_missing_columns(spark, make, tmp_path):
    text = 'last_name,email,first_name,department_id,position_id\n"Б, ""В""",q@x.org,"А\nГ",1,1\n'
    result = run(spark, make, tmp_path, ("in.csv", text), multi_line=True)
    row = result.accepted.collect()[0]
    assert (row.last_name, row.first_name) == ('Б, "В"', "А\nГ")


def test_empty_file(spark, make, tmp_path):
    result = run(spark, make, tmp_path, ("in.csv", HEADER))
    assert tuple(result.summary.collect()[0]) == (0, 0, 0)


def test_new_employees(spark, make):
    requests = spark.createDataFrame(
        [
            (1, "a@x.org", 9, None),
            (2, "a@x.org", 1, None),
            (3, "a@x.org", 1, None),
            (4, "b@x.org", 1, 77),
            (5, "old@x.org", 9, 77),
            (6, "c@x.org", None, 0),
        ],
        "request_no long, email string, department_id long, manager_id long",
    )
    checked = intake.validate_new_employees(
        requests,
        make("employees", {"employee_id": 1, "email": "old@x.org"}),
        make("departments", {"department_id": 1, "budget": None}),
    )
    assert {r.request_no: r.error for r in checked.collect()} == {
        1: labels.NO_SUCH_DEPARTMENT,
        2: None,
        3: labels.EMAIL_USED,
        4: labels.NO_SUCH_MANAGER,
        5: labels.EMAIL_USED,
        6: None,
    }


def test_append_new_and_records(make):
    target = make("skills", {"skill_id": 1})
    more = make(
        "skills",
        {"skill_id": 8},
        {"skill_id": 10, "skill_name": "Git"},
        {"skill_id": 9, "skill_name": "Git"},
        {"skill_id": 11, "skill_name": None},
    )
    merged = tables.append_new(target, more, "skill_name", "skill_id")
    assert {r.skill_id for r in merged.collect()} == {1, 9}
    _, refused = tables.split_new(target, more, "skill_name", "skill_id")
    assert {(r.skill_id, r.refused) for r in refused.collect()} == {
        (8, "key is held"),
        (10, "key is repeated"),
        (11, "no key"),
    }
    record = tables.to_records(target.select("skill_id", "description")).collect()[0].record
    assert record == '{"skill_id":1,"description":null}'


def test_load_reads_what_save_wrote(spark, make, tmp_path):
    written = {name: make(name) for name in tables.SCHEMAS}
    written["employees"] = make("employees", {"employee_id": 1})
    tables.save(written, str(tmp_path / "out"))
    loaded = tables.load(spark, str(tmp_path / "out"))
    assert {n: df.count() for n, df in loaded.items() if df.count()} == {"employees": 1}
    assert loaded["employees"].schema["salary"].dataType.simpleString() == "decimal(12,2)"


def test_clustered_tables_keep_departments_together(spark, make, tmp_path):
    rows = [{"employee_id": i, "department_id": i % 10} for i in range(200)]
    employees = make("employees", *rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.save({"employees": employees}, str(tmp_path / "c"), clustered=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    written = spark.read.parquet(str(tmp_path / "c" / "employees.parquet"))
    assert written.count() == 200
    spread = written.selectExpr("input_file_name() AS file", "department_id").distinct()
    files = written.selectExpr("input_file_name()").distinct().count()
    assert files > 1
    assert spread.count() < 10 + files


def test_shuffle_partitions_follow_the_data():
    assert partitions_for(10**6) == 200
    assert partitions_for(10**13) == 74506


def test_constraints(make):
    bad = {
        "departments": make("departments", {"department_id": 1}, {"department_id": 2}),
        "employees": make(
            "employees",
            {"employee_id": 1, "birth_date": date(2005, 2, 28), "phone": "1"},
            {"employee_id": 2, "birth_date": date(2005, 3, 1), "email": None, "phone": "1"},
            {"employee_id": 3, "department_id": 5, "manager_id": 8, "email": "A.B@C.ORG"},
        ),
        "positions": make("positions", {"position_id": 1}),
        "employee_skills": make(
            "employee_skills",
            {"employee_id": 1, "skill_id": 1, "certification_date": date(2024, 1, 1)},
        ),
    }
    report = {
        (r.table_name, r.constraint_name): r.violations
        for r in quality.constraint_report(bad, AS_OF).collect()
    }
    broken = {k: v for k, v in report.items() if v}
    assert broken == {
        ("employees", "check birth_date"): 1,
        ("employees", "not null email"): 1,
        ("employee_skills", "check certification_date"): 1,
        ("departments", "unique department_name"): 1,
        ("employees", "unique phone where phone IS NOT NULL"): 1,
        ("employees", "foreign key department_id"): 1,
        ("employees", "foreign key manager_id"): 1,
    }


def test_all_21_checks_are_present():
    assert sum(len(rules) for rules in quality.CHECKS.values()) == 21
    assert len(quality.REFERENCES) == 14
    assert len(quality.UNIQUE_KEYS) == 5


def test_requests(spark):
    raises = spark.createDataFrame([(0.0,), (0.5,), (100.0,), (100.1,), (None,)], "percent double")
    errors = [r.errors for r in quality.request_errors("raise", raises, AS_OF).collect()]
    assert errors == [["percent"], [], [], ["percent"], ["percent"]]
    vacations = spark.createDataFrame(
        [(1, date(2020, 1, 2), date(2020, 1, 1))], "employee_id long, start_date date, end_date date"
    )
    assert quality.request_errors("vacation", vacations, AS_OF).collect()[0].errors == ["dates"]


def test_large_keys_dates_lengths_and_line_breaks(spark, make, tmp_path):
    folder = tmp_path / "file.csv"
    header = "first_name,last_name,email,hire_date,salary,department_id,position_id,manager_id\n"
    big = 9007199254740993
    folder.write_text(
        header
        + f'Ann,Lee,a@b.com,1999/06/30,10,1,1,{big}\n'
        + f'Bob,Lee,b@b.com,06/29/1999,1e2,1.0,1,{big - 1}\n'
        + '"Cy\nOne",Lee,c@b.com,28.06.1999,10,1,1,\n'
        + f'{"x" * 150},Lee,d@b.com,1999-06-27,10,1,1,\n'
        + 'Eve,Lee,e@b.com,"June 26, 1999",10.25,1,1,\n'
    )
    existing = make("employees", {"employee_id": big - 1, "email": "boss@b.com"})
    lines = intake.read_numbered_csv(spark, str(folder))
    result = intake.import_employees(
        lines, existing, make("departments", {"department_id": 1, "budget": None}), make("positions", {"position_id": 1}), date(1999, 6, 30)
    )
    got = {r.row_no: r for r in result.accepted.collect()}
    assert set(got) == {2, 3, 5}
    assert (got[2].manager_id, got[2].salary, got[2].hire_date) == (big - 1, Decimal(100), date(1999, 6, 29))
    assert got[3].first_name == "Cy\nOne" and got[3].hire_date == date(1999, 6, 28)
    assert got[5].hire_date == date(1999, 6, 26) and got[5].salary == Decimal("10.25")
