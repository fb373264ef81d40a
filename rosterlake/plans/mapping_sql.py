"""The fixture tables in SQL: one common table expression per table.

The checks compare every query with SQL over the driver's tables; these
expressions derive the workforce tables there as ``sources/fixtures.py`` does
in Spark.
"""

from __future__ import annotations

import re

from ..labels import OVER_BUDGET


def taken_in(turns: str) -> str:
    """Rows of ``turns(no, email, department_id, pay)`` taken in one by one: which find their address taken, which no room."""
    return f"""
        WITH RECURSIVE numbered AS (
            SELECT *, row_number() OVER (ORDER BY no) AS t,
                   count(*) OVER (PARTITION BY email) > 1 AS contested,
                   coalesce(email IN (SELECT email FROM employees WHERE email IS NOT NULL), false) AS known
            FROM {turns}),
        walk AS (
            SELECT CAST(0 AS BIGINT) AS t, CAST(NULL AS BIGINT) AS no, CAST(NULL AS VARCHAR) AS email,
                   false AS taken, false AS over, CAST([] AS VARCHAR[]) AS held,
                   (SELECT MAP(list(department_id), list(CAST(room AS DECIMAL(20,3)))) FROM payroll_rooms) AS rooms
            UNION ALL
            SELECT t, no, email, found_taken, found_taken = false AND found_over,
                   CASE WHEN contested AND NOT found_taken AND NOT found_over THEN list_append(held, email) ELSE held END,
                   CASE WHEN found_taken OR found_over OR room IS NULL THEN rooms
                        ELSE map_concat(rooms, MAP([department_id], [CAST(room - pay AS DECIMAL(20,3))])) END
            FROM (SELECT n.*, held, rooms, rooms[n.department_id] AS room,
                         known OR list_contains(held, n.email) AS found_taken,
                         coalesce(n.pay > rooms[n.department_id], false) AS found_over
                  FROM walk w JOIN numbered n ON n.t = w.t + 1))
        SELECT no, email, taken, over FROM walk WHERE t > 0"""


TABLES: dict[str, str] = {
    "departments": """
        SELECT CAST(n_nationkey + 1 AS BIGINT) AS department_id, n_name AS department_name,
               CAST(CASE WHEN n_nationkey % 13 = 12 THEN 0
                    ELSE coalesce(n, 0) * (70000 + 9000 * (n_nationkey % 9)) END
                    AS DECIMAL(15,2)) AS budget,
               CAST(NULL AS BIGINT) AS manager_id, r_name AS location
        FROM nation
        JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)
               ON c_nationkey = n_nationkey""",
    "positions": """
        SELECT b AS position_id, p_brand AS position_title,
               CASE b % 8 WHEN 0 THEN 'trainee' WHEN 1 THEN 'junior' WHEN 2 THEN 'middle'
                    WHEN 3 THEN 'senior' WHEN 4 THEN 'lead' WHEN 5 THEN 'manager'
                    WHEN 6 THEN 'director' ELSE 'executive' END AS position_level,
               CAST(20000 + 2000 * b AS DECIMAL(10,2)) AS base_salary_min,
               CAST(60000 + 2000 * b AS DECIMAL(10,2)) AS base_salary_max
        FROM (SELECT DISTINCT p_brand, CAST(substr(p_brand, 7) AS BIGINT) AS b FROM part)""",
    "employees": """
        SELECT k + 1 AS employee_id, c_mktsegment AS first_name, last_name,
               lower(c_mktsegment) || '.' || last_name || '@company.com' AS email,
               '+7' || lpad(CAST(k % 1200 AS VARCHAR), 10, '0') AS phone, hire_date,
               CAST(30000 + c_acctbal * 10 AS DECIMAL(12,2)) AS salary,
               CAST(c_nationkey + 1 AS BIGINT) AS department_id,
               (k * 7) % 25 + 1 AS position_id,
               CASE WHEN k >= 5 THEN CAST(floor((k - 5) / 6) + 1 AS BIGINT) END AS manager_id,
               DATE '1950-01-01' + CAST((k * 97) % 10000 AS INT) AS birth_date,
               k % 11 <> 10 AS is_active,
               least(hire_date + CAST((k * 53) % 2000 AS INT), DATE '1999-06-30') AS updated_at
        FROM (SELECT *, c_custkey AS k, substr(c_name, 10) AS last_name,
                     DATE '1990-01-01' + CAST((c_custkey * 37) % 3465 AS INT) AS hire_date
              FROM customer)""",
    "projects": """
        SELECT s + 1 AS project_id, s_name AS project_name,
               'Работы для ' || s_name || ', площадка ' || CAST(s_nationkey AS VARCHAR)
                   AS description,
               CAST(s_nationkey + 1 AS BIGINT) AS department_id, start_date,
               CASE WHEN s % 5 = 0 THEN NULL WHEN s % 17 = 3 THEN start_date
                    ELSE start_date + CAST((s * 83) % 950 AS INT) END AS end_date,
               CAST(500000 + s_acctbal * 100 AS DECIMAL(15,2)) AS budget,
               CASE s % 6 WHEN 0 THEN 'planning' WHEN 3 THEN 'on_hold' WHEN 4 THEN 'completed'
                    WHEN 5 THEN 'cancelled' ELSE 'active' END AS status,
               s + 1 AS project_manager_id
        FROM (SELECT *, s_suppkey AS s,
                     DATE '1996-01-01' + CAST((s_suppkey * 41) % 1200 AS INT) AS start_date
              FROM supplier)""",
    "employee_projects": """
        SELECT o_custkey + 1 AS employee_id, l_suppkey + 1 AS project_id,
               CASE WHEN max(l_linestatus) = 'O' THEN 'lead' ELSE 'member' END
                   AS role_in_project,
               CAST(min(l_quantity) * 2 AS INT) AS participation_percentage,
               CAST(min(l_shipdate) AS DATE) AS start_date,
               CASE WHEN min(l_linenumber) % 3 = 0 THEN CAST(max(l_shipdate) AS DATE) END
                   AS end_date,
               CASE WHEN min(l_linenumber) % 2 = 0
                    THEN CAST(floor(min(l_extendedprice) / 1000) AS DECIMAL(10,2)) END
                   AS hourly_rate
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        GROUP BY o_custkey, l_suppkey""",
    "salary_history": """
        SELECT o_orderkey + 1 AS salary_change_id, o_custkey + 1 AS employee_id,
               CAST(floor(o_totalprice / 10) AS DECIMAL(12,2)) AS old_salary,
               CAST(floor(o_totalprice / 10)
                    + floor(o_totalprice * (1 + o_orderkey % 15) / 1000) AS DECIMAL(12,2))
                   AS new_salary,
               CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 YEAR AS DATE) AS change_date, o_orderpriority AS change_reason,
               o_orderkey % 5 + 1 AS changed_by
        FROM orders""",
    "vacations": """
        SELECT vacation_id, employee_id, vacation_type, start_date, end_date,
               CAST(end_date - start_date + 1 AS INT) AS days_count, status, approved_by
        FROM (SELECT l_orderkey * 10 + l_linenumber AS vacation_id,
                     min(o_custkey) + 1 AS employee_id,
                     CASE l_linenumber % 5 WHEN 0 THEN 'annual' WHEN 1 THEN 'sick'
                          WHEN 2 THEN 'maternity' WHEN 3 THEN 'unpaid' ELSE 'other' END
                         AS vacation_type,
                     CAST(min(l_shipdate) AS DATE) AS start_date,
                     CAST(min(l_shipdate) AS DATE) + CAST(min(l_quantity) + 14 AS INT)
                         AS end_date,
                     CASE WHEN max(l_returnflag) = 'A' THEN 'taken'
                          WHEN max(l_returnflag) <> 'R' THEN 'requested' ELSE
                     CASE min(l_partkey) % 5 WHEN 0 THEN 'requested' WHEN 1 THEN 'approved'
                          WHEN 2 THEN 'taken' WHEN 3 THEN 'rejected' ELSE 'cancelled' END END
                         AS status,
                     min(l_suppkey) + 1 AS approved_by
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey
              GROUP BY l_orderkey, l_linenumber)""",
    "skills": """
        SELECT p_name AS skill_name, min(p_type) AS category, min(p_partkey) + 1 AS skill_id
        FROM part GROUP BY p_name""",
    "employee_skills": """
        SELECT o_custkey + 1 AS employee_id, skill_id,
               CASE WHEN max(l_quantity) >= 45 THEN 'expert'
                    WHEN max(l_quantity) >= 30 THEN 'advanced'
                    WHEN max(l_quantity) >= 15 THEN 'intermediate'
                    ELSE 'beginner' END AS proficiency_level,
               max(l_discount) >= 0.08 AS certified
        FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey
        JOIN part ON l_partkey = p_partkey
        JOIN skills ON p_name = skill_name
        GROUP BY o_custkey, skill_id""",
    "before_rows": "SELECT * FROM employees",
    "after_rows": """
        SELECT * REPLACE (
                   CAST(CASE WHEN employee_id % 9 = 0 THEN round(salary * 1.05, 2)
                        WHEN employee_id % 31 = 0 THEN round(salary * 0.95, 2)
                        ELSE salary END AS DECIMAL(12,2)) AS salary,
                   CASE WHEN employee_id % 23 = 0 THEN department_id % 25 + 1
                        ELSE department_id END AS department_id,
                   CASE WHEN employee_id % 29 = 0 THEN position_id % 25 + 1
                        ELSE position_id END AS position_id),
               DATE '1999-06-30' - CAST(employee_id % 17 AS INT) AS changed_on
        FROM (SELECT * REPLACE (CASE WHEN employee_id % 50 = 0 THEN employee_id + 1000000000
                                ELSE employee_id END AS employee_id) FROM employees)""",
    "cyclic": """
        SELECT * REPLACE (CASE employee_id WHEN 2 THEN 13 WHEN 3 THEN 19 WHEN 5 THEN 5
                               WHEN 4 THEN 999999999 ELSE manager_id END AS manager_id)
        FROM employees""",
    "changes": """
        SELECT event_id AS change_id, ts AS changed_at, user_id + 1 AS employee_id,
               CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE'
                    ELSE 'UPDATE' END AS operation,
               CAST(30000 + value * 100 AS DECIMAL(12,2)) AS old_salary,
               CAST(30000 + value * 100 * (1 + (event_id % 3) * CAST(0.1 AS DOUBLE))
                    AS DECIMAL(12,2)) AS new_salary
        FROM events""",
    "audit_log": """
        SELECT 'employees' AS table_name, employee_id AS record_id,
               operation AS operation_type,
               CASE WHEN operation <> 'INSERT'
                    THEN '{"salary":' || CAST(old_salary AS VARCHAR) || '}' END AS old_values,
               CASE WHEN operation <> 'DELETE'
                    THEN '{"salary":' || CAST(new_salary AS VARCHAR) || '}' END AS new_values,
               CAST(1 AS BIGINT) AS changed_by, changed_at
        FROM changes""",
    # Tables with broken values at known keys, for the quality checks.
    "bad_departments": """
        SELECT department_id,
               CASE WHEN department_id % 9 = 0 THEN 'NATION_0' ELSE department_name END
                   AS department_name,
               CASE WHEN department_id % 10 = 0 THEN -1 ELSE budget END AS budget
        FROM departments""",
    "bad_positions": """
        SELECT position_id,
               CASE WHEN position_id > 20 THEN 'Brand' ELSE position_title END
                   AS position_title,
               CASE WHEN position_id % 6 = 0 THEN 'chief' ELSE position_level END
                   AS position_level,
               base_salary_min,
               CASE WHEN position_id % 7 = 0 THEN 1 ELSE base_salary_max END
                   AS base_salary_max
        FROM positions""",
    "bad_employees": """
        SELECT employee_id, CASE WHEN employee_id % 67 <> 0 THEN first_name END AS first_name,
               last_name,
               CASE WHEN employee_id % 43 = 0 THEN replace(email, '@', '#')
                    WHEN employee_id % 71 = 0 THEN 'twice@company.com' ELSE email END AS email,
               phone,
               CASE WHEN employee_id % 53 = 0 THEN DATE '1999-07-15' ELSE hire_date END
                   AS hire_date,
               CASE WHEN employee_id % 41 = 0 THEN -salary ELSE salary END AS salary,
               CASE WHEN employee_id % 59 = 0 THEN 99 ELSE department_id END AS department_id,
               position_id,
               CASE WHEN employee_id % 61 = 0 THEN 999999999 ELSE manager_id END AS manager_id,
               CASE WHEN employee_id % 47 = 0 THEN DATE '1985-01-01' ELSE birth_date END
                   AS birth_date,
               is_active
        FROM employees""",
    "bad_projects": """
        SELECT project_id, project_name, department_id, start_date,
               CASE WHEN project_id % 7 = 0 THEN start_date - 1 ELSE end_date END AS end_date,
               CASE WHEN project_id % 11 = 0 THEN -1 ELSE budget END AS budget,
               CASE WHEN project_id % 9 = 0 THEN 'unknown' ELSE status END AS status,
               project_manager_id
        FROM projects""",
    "bad_employee_projects": """
        SELECT CASE WHEN employee_id % 101 <> 0
                    THEN (employee_id - CASE WHEN employee_id % 103 = 0 THEN 1 ELSE 0 END) * 1000000
                         + project_id END AS employee_project_id,
               employee_id, project_id,
               CASE WHEN employee_id % 107 = 0 THEN repeat('x', 101) ELSE role_in_project END
                   AS role_in_project,
               participation_percentage + CASE WHEN employee_id % 73 = 0 THEN 60 ELSE 0 END
                   AS participation_percentage,
               start_date, end_date,
               CASE WHEN employee_id % 79 = 0 THEN -hourly_rate ELSE hourly_rate END
                   AS hourly_rate
        FROM employee_projects""",
    "bad_salary_history": """
        SELECT salary_change_id, employee_id, old_salary,
               CASE WHEN salary_change_id % 97 = 0 THEN old_salary - 1 ELSE new_salary END
                   AS new_salary,
               CASE WHEN salary_change_id % 89 = 0 THEN DATE '1999-08-01' ELSE change_date END
                   AS change_date,
               change_reason,
               CASE WHEN salary_change_id % 83 = 0 THEN 888888888 ELSE changed_by END
                   AS changed_by
        FROM salary_history""",
    "bad_vacations": """
        SELECT vacation_id, employee_id,
               CASE WHEN vacation_id % 89 = 0 THEN 'holiday' ELSE vacation_type END
                   AS vacation_type,
               start_date,
               CASE WHEN vacation_id % 83 = 0 THEN start_date - 5 ELSE end_date END
                   AS end_date,
               CASE WHEN vacation_id % 79 = 0 THEN 'lost' ELSE status END AS status,
               approved_by
        FROM vacations""",
    "bad_skills": """
        SELECT skill_name, category,
               CASE WHEN skill_id % 10 = 0 THEN skill_id + 1000000000 ELSE skill_id END
                   AS skill_id
        FROM skills""",
    "bad_employee_skills": """
        SELECT employee_id - CASE WHEN employee_id % 10 = 0 THEN 1 ELSE 0 END AS employee_id,
               skill_id,
               CASE WHEN (employee_id + skill_id) % 83 = 0 THEN 'guru'
                    ELSE proficiency_level END AS proficiency_level, certified,
               employee_id * 1000000 + skill_id AS employee_skill_id,
               CASE WHEN (employee_id + skill_id) % 89 = 0 THEN DATE '1999-12-31'
                    WHEN certified THEN DATE '1998-01-01' END AS certification_date
        FROM employee_skills""",
    "bad_audit_log": """
        SELECT change_id AS log_id, 'employees' AS table_name, employee_id AS record_id,
               CASE WHEN change_id % 79 = 0 THEN 'CALCULATE' ELSE operation END
                   AS operation_type,
               employee_id AS changed_by
        FROM changes""",
    # Customers as an import file, and the verdict on every row.
    "csv_rows": """
        SELECT k + 1 AS row_no, CASE WHEN k % 29 <> 0 THEN first_name END AS first_name,
               last_name,
               CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN replace(email, '@', ' at ')
                    WHEN k % 19 = 0
                    THEN 'shared.' || CAST(k % 3 AS VARCHAR) || '@company.com'
                    WHEN k % 23 = 0 THEN email ELSE 'new.' || email END AS email,
               CASE WHEN k % 31 = 0 THEN DATE '1999-06-30' ELSE hire_date END AS hire_date,
               CASE WHEN k % 37 = 0 THEN NULL WHEN k % 7 = 0 THEN 0
                    ELSE salary - 31000 END AS salary,
               CASE WHEN k % 41 = 0 THEN 99 ELSE department_id END AS department_id,
               position_id, manager_id
        FROM (SELECT *, employee_id - 1 AS k FROM employees)""",
    "csv_faults": """
        SELECT *,
               CASE WHEN email IS NULL OR first_name IS NULL
                    THEN 'Отсутствуют обязательные поля'
                    WHEN strpos(email, '@') = 0 THEN 'Неверный формат email' END AS early,
               CASE WHEN salary IS NULL THEN 'Неверное значение поля'
                    WHEN salary < 0 THEN 'Зарплата не может быть отрицательной'
                    WHEN department_id = 99 THEN 'Нарушено ограничение таблицы' END AS late
        FROM csv_rows""",
    "payroll_rooms": """
        SELECT d.department_id, budget * 7 / 10 - coalesce(fund, 0) AS room
        FROM departments d
        LEFT JOIN (SELECT department_id, sum(salary) AS fund FROM employees WHERE is_active
                   GROUP BY department_id) USING (department_id)""",
    "csv_turns": """
        SELECT row_no AS no, email, department_id, CAST(salary AS DECIMAL(20,2)) AS pay
        FROM csv_faults WHERE early IS NULL AND late IS NULL""",
    "csv_taken_in": taken_in("csv_turns"),
    "csv_verdicts": f"""
        SELECT r.*,
               coalesce(early,
                        CASE WHEN h.holder < r.row_no
                             THEN 'Email ' || r.email || ' уже существует' END,
                        late,
                        CASE WHEN w.over THEN '{OVER_BUDGET}' END) AS reason
        FROM csv_faults r
        LEFT JOIN csv_taken_in w ON w.no = r.row_no
        LEFT JOIN (SELECT email, min(holder) AS holder
                   FROM (SELECT email, -1 AS holder FROM employees
                         UNION ALL
                         SELECT email, no FROM csv_taken_in WHERE NOT taken AND NOT over)
                   GROUP BY email) h ON h.email = r.email""",
}


def with_tables(body: str) -> str:
    """``body`` preceded by the expressions it needs, in order of dependence."""
    needed: list[str] = []

    def add(sql: str) -> None:
        for word in re.findall(r"\b\w+\b", sql):
            if word in TABLES and word not in needed:
                add_table(word)

    def add_table(name: str) -> None:
        pending = set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", TABLES[name]))
        for other in TABLES:
            if other in pending and other != name and other not in needed:
                add_table(other)
        if name not in needed:
            needed.append(name)

    add(body)
    expressions = [f"{name} AS ({TABLES[name]})" for name in needed]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        expressions.append(body[len("WITH RECURSIVE") :].lstrip())
        return "WITH RECURSIVE " + ",\n".join(expressions)
    if body.upper().startswith("WITH"):
        expressions.append(body[len("WITH") :].lstrip())
        return "WITH " + ",\n".join(expressions)
    return ("WITH " + ",\n".join(expressions) + "\n" if expressions else "") + body
