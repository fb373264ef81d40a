from rosterlake.operators import hierarchy


def staff(make, *rows):
    return make(
        "employees",
        *[
            {"employee_id": e, "manager_id": m, "first_name": "E", "last_name": str(e), "is_active": a}
            for e, m, a in rows
        ],
    )


def places(make):
    return make("departments", {"department_id": 1}), make("positions", {"position_id": 1})


def test_inactive_manager_cuts_the_subtree(make):
    employees = staff(
        make, (1, None, True), (2, 1, False), (3, 2, True), (4, 3, True), (5, 1, True)
    )
    tree = hierarchy.employee_hierarchy(employees, *places(make)).collect()
    assert [(r.employee_id, r.level, r.reporting_path) for r in tree] == [
        (1, 1, "E 1"),
        (5, 2, "E 1 → E 5"),
    ]
    assert tree[1].indented_name == "  E 5"
    assert tree[1].manager_name == "E 1"


def test_subordinates_include_inactive_staff(make):
    employees = staff(
        make, (1, None, True), (2, 1, False), (3, 2, True), (4, 3, True), (5, 1, True)
    )
    below = hierarchy.subordinates(employees, 1).collect()
    assert [(r.employee_id, r.level) for r in below] == [(2, 1), (5, 1), (3, 2), (4, 3)]
    active = hierarchy.manager_subordinates(employees, places(make)[1], 1).collect()
    assert [r.subordinate_id for r in active] == [5]
    assert hierarchy.subordinates(employees, 4).collect() == []


def test_long_line_matches_recursive_sql(spark, make):
    employees = staff(
        make, *[(i, i - 1 if i > 1 else None, True) for i in range(1, 41)], (50, 7, True), (51, 50, True)
    )
    tree = hierarchy.employee_hierarchy(employees, *places(make), ordered=False)
    employees.createOrReplaceTempView("line_staff")
    recursive = spark.sql(
        """WITH RECURSIVE tree AS (
             SELECT employee_id, 1 AS level, first_name || ' ' || last_name AS path
             FROM line_staff WHERE manager_id IS NULL
             UNION ALL
             SELECT e.employee_id, t.level + 1, t.path || ' → ' || e.first_name || ' ' || e.last_name
             FROM line_staff e JOIN tree t ON e.manager_id = t.employee_id)
           SELECT * FROM tree"""
    )
    ours = {(r.employee_id, r.level, r.reporting_path) for r in tree.collect()}
    assert ours == {(r.employee_id, r.level, r.path) for r in recursive.collect()}
    assert len(ours) == 42


def test_loops_do_not_hang(make):
    employees = staff(
        make,
        (1, None, True),
        (2, 3, True),
        (3, 2, True),
        (4, 2, True),
        (5, 4, True),
        (6, 6, True),
        (7, 6, True),
        (8, 99, True),
        (9, 1, True),
    )
    found = {(r.employee_id, r.violation) for r in hierarchy.hierarchy_violations(employees).collect()}
    assert found == {(2, "cycle"), (3, "cycle"), (6, "self_manager")}
    tree = hierarchy.employee_hierarchy(employees, *places(make)).collect()
    assert {r.employee_id for r in tree} == {1, 9}
    assert {r.employee_id for r in hierarchy.subordinates(employees, 2).collect()} == {3, 4, 5}
    assert {r.employee_id for r in hierarchy.subordinates(employees, 6).collect()} == {7}


def test_tails_of_any_length_below_a_loop(make):
    loop = [(1, 3, True), (2, 1, True), (3, 2, True)]
    tail = [(i, i - 1, True) for i in range(4, 25)]
    found = hierarchy.hierarchy_violations(staff(make, *loop, *tail)).collect()
    assert {r.employee_id for r in found} == {1, 2, 3}


def test_no_loops_in_a_sound_tree(make):
    assert hierarchy.hierarchy_violations(staff(make, (1, None, True), (2, 1, True))).count() == 0
    assert hierarchy.hierarchy_violations(staff(make)).count() == 0


def test_a_long_line_takes_few_rounds(spark, make):
    rows = [(i, i - 1 if i > 1 else None) for i in range(1, 1001)]
    edges = spark.createDataFrame(rows, "employee_id long, manager_id long")
    named = edges.selectExpr("*", "'A' AS first_name", "cast(employee_id as string) AS last_name")
    found = hierarchy.subordinates(named, 3, ordered=False)
    assert {(r.employee_id, r.level) for r in found.collect()} == {(i, i - 3) for i in range(4, 1001)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") < 40
