"""SQL twins of the queries, for checking them over the driver's tables."""

from __future__ import annotations

import re

from ..labels import OVER_BUDGET
from .mapping_sql import taken_in, with_tables


def full(alias: str = "") -> str:
    dot = f"{alias}." if alias else ""
    return f"{dot}first_name || ' ' || {dot}last_name"


EMPLOYEE_COLUMNS = (
    "e.employee_id, e.first_name, e.last_name, e.email, e.phone, e.hire_date, "
    "CAST(e.salary AS DOUBLE) AS salary, e.department_id, e.position_id, e.manager_id, "
    "e.birth_date, e.is_active, e.updated_at"
)

# What assignments cost a month, in cents times 1200, as a whole number.
COST_POINTS = """CAST(sum(CASE WHEN hourly_rate IS NOT NULL
                              THEN hourly_rate * 192000 * participation_percentage
                              ELSE salary * 100 * participation_percentage END) AS HUGEINT)"""


def from_points(points: str) -> str:
    """Points as money, rounded half away from zero without leaving whole numbers."""
    return (
        f"sign({points}) * (abs({points}) + 600 - (abs({points}) + 600) % 1200) / 1200 / 100"
    )


def ratio(above: str, below: str) -> str:
    """A quotient of whole numbers to two digits, rounded half up exactly."""
    top = f"(200 * CAST({above} AS HUGEINT) + {below})"
    return f"({top} - {top} % (2 * {below})) / (2 * {below}) / 100"


def mean(amount: str, where: str = "") -> str:
    """The average of an amount with two digits; NULL over nothing."""
    only = f" FILTER (WHERE {where})" if where else ""
    below = f"(100 * nullif(count({amount}){only}, 0))"
    return ratio(f"sum({amount}){only} * 100", below)


def share(part: str, whole: str) -> str:
    """An amount as a percentage of another, both with two digits."""
    return ratio(f"({part}) * 10000", f"nullif(CAST({whole} * 100 AS HUGEINT), 0)")


HIRES_BY_MONTH = f"""
    hires AS (
        SELECT date_trunc('month', hire_date) AS m, count(*) AS n, avg(salary) AS pay,
               {mean('salary')} AS pay_shown
        FROM employees
        WHERE is_active AND hire_date BETWEEN DATE '1998-06-30' AND DATE '1999-06-30'
        GROUP BY 1),
    newest AS (
        SELECT n, pay, pay_shown, coalesce(lag(n) OVER (ORDER BY m), 0) AS n_before,
               coalesce(lag(pay) OVER (ORDER BY m), 0) AS pay_before
        FROM hires ORDER BY m DESC LIMIT 1)"""


def trend(value: str, before: str) -> str:
    return (
        f"CASE WHEN {value} > {before} THEN '↑ рост' WHEN {value} < {before} "
        "THEN '↓ снижение' ELSE '→ стабильно' END AS trend"
    )


NEW_HIRES = f"""
    SELECT 'Новых сотрудников' AS metric_name, CAST(n AS DOUBLE) AS metric_value,
           'человек' AS metric_unit, {trend('n', 'n_before')} FROM newest"""
HIRE_PAY = f"""
    SELECT 'Средняя зарплата' AS metric_name, pay_shown AS metric_value,
           'руб.' AS metric_unit, {trend('pay', 'pay_before')} FROM newest"""
TURNOVER = """
    SELECT 'Текучесть кадров' AS metric_name, rate AS metric_value, '%' AS metric_unit,
           CASE WHEN rate > 10 THEN '⚠ высокая' WHEN rate < 5 THEN '✓ низкая'
                ELSE '→ средняя' END AS trend
    FROM (SELECT round(100.0 * count(*) FILTER (WHERE NOT is_active) / count(*), 2) AS rate
          FROM employees
          WHERE hire_date BETWEEN DATE '1998-06-30' AND DATE '1999-06-30'
             OR (NOT is_active
                 AND updated_at BETWEEN DATE '1998-06-30' AND DATE '1999-06-30'))"""
UTILIZATION = """
    SELECT 'Использование бюджета отделов' AS metric_name, round(rate, 2) AS metric_value,
           '%' AS metric_unit,
           CASE WHEN rate > 65 THEN '⚠ перегружен' WHEN rate < 40 THEN '✓ недогружен'
                ELSE '→ оптимально' END AS trend
    FROM (SELECT avg(fund * 100 / nullif(CAST(budget AS DOUBLE), 0)) AS rate
          FROM departments
          JOIN (SELECT department_id, sum(salary) AS fund FROM employees
                WHERE is_active GROUP BY 1) USING (department_id))"""


def _details_sql() -> str:
    return f"""
        SELECT {EMPLOYEE_COLUMNS.replace("e.department_id, e.position_id, e.manager_id, ", "")
                .replace("e.birth_date, ", "").replace(", e.updated_at", "")},
               department_name, CAST(budget AS DOUBLE) AS department_budget,
               position_title, position_level,
               CAST(base_salary_min AS DOUBLE) AS base_salary_min,
               CAST(base_salary_max AS DOUBLE) AS base_salary_max,
               boss.first_name AS manager_first_name, boss.last_name AS manager_last_name,
               boss.email AS manager_email,
               CAST(1999 - year(e.hire_date)
                    - CASE WHEN month(e.hire_date) * 100 + day(e.hire_date) > 630
                           THEN 1 ELSE 0 END AS INT) AS years_in_company,
               CASE WHEN e.salary < base_salary_min THEN 'Ниже вилки'
                    WHEN e.salary > base_salary_max THEN 'Выше вилки'
                    ELSE 'В пределах вилки' END AS salary_benchmark,
               CASE WHEN e.is_active THEN 'Активен' ELSE 'Не активен' END AS activity_status
        FROM employees e
        LEFT JOIN departments USING (department_id)
        LEFT JOIN positions USING (position_id)
        LEFT JOIN employees boss ON boss.employee_id = e.manager_id"""


LEVEL_PAY = ", ".join(
    mean("salary", f"proficiency_level = '{level}'") + f" AS avg_salary_{level}"
    for level in ("beginner", "intermediate", "advanced", "expert")
)

SKILL_SQL = f"""
    WITH holders AS (
        SELECT es.*, e.salary, d.department_name
        FROM employee_skills es
        LEFT JOIN (SELECT * FROM employees WHERE is_active) e USING (employee_id)
        LEFT JOIN departments d USING (department_id)),
    front AS (
        SELECT skill_id, string_agg(department_name, ', ' ORDER BY place) AS names
        FROM (SELECT skill_id, department_name,
                     row_number() OVER (PARTITION BY skill_id
                                        ORDER BY count(DISTINCT employee_id) DESC,
                                                 department_name) AS place
              FROM holders WHERE department_name IS NOT NULL GROUP BY 1, 2)
        WHERE place <= 3 GROUP BY 1)
    SELECT s.skill_id, s.skill_name, s.category,
           count(DISTINCT h.employee_id) AS employees_with_skill,
           count(DISTINCT h.employee_id) FILTER (WHERE certified) AS certified_employees,
           count(DISTINCT h.employee_id) FILTER (WHERE proficiency_level = 'beginner')
               AS beginners,
           count(DISTINCT h.employee_id) FILTER (WHERE proficiency_level = 'intermediate')
               AS intermediate,
           count(DISTINCT h.employee_id) FILTER (WHERE proficiency_level = 'advanced')
               AS advanced,
           count(DISTINCT h.employee_id) FILTER (WHERE proficiency_level = 'expert') AS experts,
           {LEVEL_PAY},
           coalesce(any_value(names), '') AS top_departments
    FROM skills s
    LEFT JOIN holders h USING (skill_id)
    LEFT JOIN front l ON l.skill_id = s.skill_id
    GROUP BY s.skill_id, s.skill_name, s.category"""

TREE_SQL = f"""
    WITH RECURSIVE tree AS (
        SELECT employee_id, 1 AS level, {full()} AS path
        FROM employees WHERE is_active AND manager_id IS NULL
        UNION ALL
        SELECT e.employee_id, t.level + 1, t.path || ' → ' || {full('e')}
        FROM tree t JOIN employees e ON e.manager_id = t.employee_id
        WHERE e.is_active)
    SELECT e.employee_id, e.first_name, e.last_name, position_title, department_name,
           e.manager_id, {full('boss')} AS manager_name, CAST(level AS INT) AS level,
           path AS reporting_path,
           repeat('  ', CAST(level - 1 AS INT)) || {full('e')} AS indented_name
    FROM tree
    JOIN employees e USING (employee_id)
    LEFT JOIN positions USING (position_id)
    LEFT JOIN departments USING (department_id)
    LEFT JOIN employees boss ON boss.employee_id = e.manager_id"""

BELOW_SQL = """
    WITH RECURSIVE below AS (
        SELECT employee_id, 1 AS level FROM employees WHERE manager_id = 2
        UNION ALL
        SELECT e.employee_id, b.level + 1
        FROM below b JOIN employees e ON e.manager_id = b.employee_id)
    SELECT e.employee_id, first_name, last_name, manager_id, is_active,
           CAST(level AS INT) AS level
    FROM below JOIN employees e USING (employee_id)"""

REPORTS_SQL = f"""
    WITH RECURSIVE staff AS (
        SELECT employee_id, manager_id, position_title, {full()} AS name
        FROM employees JOIN positions USING (position_id) WHERE is_active),
    below AS (
        SELECT employee_id, name, position_title, 1 AS level, name AS path
        FROM staff WHERE manager_id = 1
        UNION ALL
        SELECT s.employee_id, s.name, s.position_title, b.level + 1, b.path || ' → ' || s.name
        FROM below b JOIN staff s ON s.manager_id = b.employee_id)
    SELECT employee_id AS subordinate_id, name AS subordinate_name,
           position_title AS subordinate_position, CAST(level AS INT) AS hierarchy_level,
           path AS reporting_path
    FROM below"""

LOOP_SQL = """
    WITH RECURSIVE up AS (
        SELECT employee_id, manager_id AS superior FROM cyclic
        WHERE manager_id IS NOT NULL AND manager_id <> employee_id
        UNION
        SELECT u.employee_id, c.manager_id
        FROM up u JOIN cyclic c ON c.employee_id = u.superior
        WHERE c.manager_id IS NOT NULL AND c.manager_id <> c.employee_id)
    SELECT employee_id, 'cycle' AS violation FROM up WHERE employee_id = superior
    UNION ALL
    SELECT employee_id, 'self_manager' FROM cyclic WHERE manager_id = employee_id"""


def _audit_json(alias: str) -> str:
    def text(column: str) -> str:
        return f'"{column}":"\' || {alias}.{column} || \'"'

    def plain(column: str) -> str:
        return f'"{column}":\' || coalesce(CAST({alias}.{column} AS VARCHAR), \'null\') || \''

    fields = [text("first_name"), text("last_name"), text("email")]
    fields += [plain(c) for c in ("salary", "department_id", "position_id", "manager_id")]
    return f"CASE WHEN {alias}.employee_id IS NOT NULL THEN '{{{','.join(fields)}}}' END"


SNAPSHOT_COLUMNS = [
    "first_name",
    "last_name",
    "email",
    "phone",
    "hire_date",
    "salary",
    "department_id",
    "position_id",
    "manager_id",
    "birth_date",
    "is_active",
    "updated_at",
]
ANY_CHANGE = " OR ".join(f"b.{c} IS DISTINCT FROM a.{c}" for c in SNAPSHOT_COLUMNS)

AUDIT_SQL = f"""
    SELECT 'employees' AS table_name, coalesce(b.employee_id, a.employee_id) AS record_id,
           CASE WHEN b.employee_id IS NULL THEN 'INSERT' WHEN a.employee_id IS NULL
                THEN 'DELETE' ELSE 'UPDATE' END AS operation_type,
           {_audit_json('b')} AS old_values, {_audit_json('a')} AS new_values,
           CAST(1 AS BIGINT) AS changed_by, DATE '1999-06-30' AS changed_at
    FROM before_rows b FULL JOIN after_rows a ON a.employee_id = b.employee_id
    WHERE b.employee_id IS NULL OR a.employee_id IS NULL OR {ANY_CHANGE}"""


POSITION_BY_SALARY = """CASE
    WHEN salary >= 250000 THEN 1
    WHEN salary >= 200000 AND contains(department_name, 'Руковод') THEN 1
    WHEN salary >= 200000 AND contains(department_name, 'ИТ') THEN 2
    WHEN salary >= 180000 AND contains(department_name, 'Финан') THEN 3
    WHEN salary >= 150000 AND contains(department_name, 'Разраб') THEN 4
    WHEN salary >= 150000 AND contains(department_name, 'Продаж') THEN 6
    WHEN salary >= 120000 AND contains(department_name, 'ИТ') THEN 7
    WHEN salary >= 90000 AND contains(department_name, 'ИТ') THEN 8
    WHEN salary >= 80000 AND contains(department_name, 'Бухгал') THEN 14
    WHEN salary >= 70000 AND contains(department_name, 'Продаж') THEN 12
    WHEN salary >= 65000 AND contains(department_name, 'Маркет') THEN 13
    WHEN salary >= 60000 AND contains(department_name, 'Кадр') THEN 15
    WHEN salary >= 50000 AND contains(department_name, 'ИТ') THEN 9
    WHEN salary >= 40000 AND contains(department_name, 'Поддерж') THEN 16
    WHEN salary >= 35000 THEN 18
    ELSE 18 END"""


NAMED_DEPARTMENTS = """
    (SELECT department_id,
            list_extract(['Руководство','ИТ','Финансы','Разработка','Продажи','Бухгалтерия',
                          'Маркетинг','Кадры','Поддержка','Склад'],
                         CAST(department_id % 10 + 1 AS INT)) AS department_name
     FROM departments)"""


def _dirty(table: str) -> str:
    return f"bad_{table}"


EMAIL_SQL = "regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$')"

# The rules of the data model, written down apart from the engine's own lists. By table: key,
# required columns, longest texts, checks, unique keys (with a condition), references.
MODEL = {
    "departments": {
        "key": "department_id",
        "required": "department_id department_name budget",
        "length": {"department_name": 255, "location": None},
        "check": {"budget_positive": "budget >= 0"},
        "unique": [("department_name", "")],
    },
    "positions": {
        "key": "position_id",
        "required": "position_id position_title position_level base_salary_min base_salary_max",
        "length": {"position_title": 255, "position_level": 50},
        "check": {
            "salary_range": "base_salary_max >= base_salary_min",
            "level_value": "position_level IN ('trainee', 'junior', 'middle', 'senior', 'lead', "
            "'manager', 'director', 'executive')",
        },
        "unique": [("position_title", "")],
    },
    "employees": {
        "key": "employee_id",
        "required": "employee_id first_name last_name email hire_date salary department_id position_id",
        "length": {"first_name": 100, "last_name": 100, "email": 255, "phone": 20},
        "check": {
            "email_format": EMAIL_SQL,
            "salary_positive": "salary >= 0",
            "hire_date": "hire_date <= DATE '1999-06-30'",
            "birth_date": "birth_date <= DATE '1981-06-30'",
        },
        "unique": [("email", ""), ("phone", "phone IS NOT NULL")],
        "reference": [
            ("department_id", "departments", "department_id"),
            ("position_id", "positions", "position_id"),
            ("manager_id", "employees", "employee_id"),
        ],
    },
    "projects": {
        "key": "project_id",
        "required": "project_id project_name department_id start_date budget status project_manager_id",
        "length": {"project_name": 255, "status": 50},
        "check": {
            "budget_positive": "budget >= 0",
            "dates": "end_date >= start_date",
            "status_value": "status IN ('planning', 'active', 'on_hold', 'completed', 'cancelled')",
        },
        "reference": [
            ("department_id", "departments", "department_id"),
            ("project_manager_id", "employees", "employee_id"),
        ],
    },
    "employee_projects": {
        "key": "employee_project_id",
        "required": "employee_project_id employee_id project_id role_in_project "
        "participation_percentage start_date",
        "length": {"role_in_project": 100},
        "check": {
            "percentage": "participation_percentage BETWEEN 0 AND 100",
            "hourly_rate": "hourly_rate >= 0",
            "dates_project": "end_date >= start_date",
        },
        "unique": [("employee_id, project_id", "end_date IS NULL")],
        "reference": [
            ("employee_id", "employees", "employee_id"),
            ("project_id", "projects", "project_id"),
        ],
    },
    "salary_history": {
        "key": "salary_change_id",
        "required": "salary_change_id employee_id old_salary new_salary change_date change_reason "
        "changed_by",
        "length": {"change_reason": 255},
        "check": {
            "salary_increase": "new_salary >= old_salary",
            "change_date": "change_date <= DATE '1999-06-30'",
        },
        "reference": [
            ("employee_id", "employees", "employee_id"),
            ("changed_by", "employees", "employee_id"),
        ],
    },
    "vacations": {
        "key": "vacation_id",
        "required": "vacation_id employee_id vacation_type start_date end_date status",
        "length": {"vacation_type": 50, "status": 50},
        "check": {
            "dates_vacation": "end_date >= start_date",
            "vacation_type": "vacation_type IN ('annual', 'sick', 'maternity', 'unpaid', 'other')",
            "status": "status IN ('requested', 'approved', 'rejected', 'taken', 'cancelled')",
        },
        "reference": [
            ("employee_id", "employees", "employee_id"),
            ("approved_by", "employees", "employee_id"),
        ],
    },
    "skills": {
        "key": "skill_id",
        "required": "skill_id skill_name category",
        "length": {"skill_name": 255, "category": 100},
        "unique": [("skill_name", "")],
    },
    "employee_skills": {
        "key": "employee_skill_id",
        "required": "employee_skill_id employee_id skill_id proficiency_level",
        "length": {"proficiency_level": 50},
        "check": {
            "proficiency_level": "proficiency_level IN ('beginner', 'intermediate', 'advanced', "
            "'expert')",
            "certification_date": "certification_date <= DATE '1999-06-30'",
        },
        "unique": [("employee_id, skill_id", "")],
        "reference": [
            ("employee_id", "employees", "employee_id"),
            ("skill_id", "skills", "skill_id"),
        ],
    },
    "audit_log": {
        "key": "log_id",
        "required": "log_id table_name record_id operation_type",
        "length": {"table_name": 100, "operation_type": 10},
        "check": {"operation_type": "operation_type IN ('INSERT', 'UPDATE', 'DELETE')"},
        "reference": [("changed_by", "employees", "employee_id")],
    },
}


def _count_line(table: str, name: str, count: str, source: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{name}' AS constraint_name, "
        f"CAST({count} AS BIGINT) AS violations FROM {source}"
    )


def _required_lines(table: str) -> list[str]:
    return [
        _count_line(table, f"not null {c}", f"count(*) FILTER (WHERE {c} IS NULL)", _dirty(table))
        for c in MODEL[table]["required"].split()
    ]


def _repeated(table: str, columns: str, condition: str) -> str:
    return (
        f"(SELECT {columns} FROM {_dirty(table)} WHERE {condition} "
        f"GROUP BY {columns} HAVING count(*) > 1)"
    )


def _constraint_sql() -> str:
    lines = []
    for table, model in MODEL.items():
        for name, condition in model.get("check", {}).items():
            broken = f"count(*) FILTER (WHERE NOT ({condition}))"
            lines.append(_count_line(table, f"check {name}", broken, _dirty(table)))
        lines += _required_lines(table)
        for column, most in model["length"].items():
            # The fixture has no such column, so no text in it can be too long.
            broken = f"count(*) FILTER (WHERE length({column}) > {most})" if most else "count(*) - count(*)"
            lines.append(_count_line(table, f"length {column}", broken, _dirty(table)))
        key = model["key"]
        lines.append(
            _count_line(table, f"primary key {key}", "count(*)", _repeated(table, key, f"{key} IS NOT NULL"))
        )
        for columns, condition in model.get("unique", []):
            name = f"unique {columns} where {condition}" if condition else f"unique {columns}"
            present = " AND ".join(f"{c} IS NOT NULL" for c in columns.split(", "))
            where = f"{present} AND {condition}" if condition else present
            lines.append(_count_line(table, name, "count(*)", _repeated(table, columns, where)))
        for column, parent, other in model.get("reference", []):
            lines.append(
                _count_line(
                    table,
                    f"foreign key {column}",
                    "count(*)",
                    f"{_dirty(table)} child WHERE child.{column} IS NOT NULL AND NOT EXISTS "
                    f"(SELECT 1 FROM {_dirty(parent)} p WHERE p.{other} = child.{column})",
                )
            )
    return "\nUNION ALL ".join(lines)


def _change_sql() -> str:
    """The report over the dirty tables after some rows changed, less the one before."""
    before = _constraint_sql()
    after = re.sub(r"\bbad_(employees|departments)\b", r"next_\1", before)
    return f"""WITH next_employees AS (
            SELECT * REPLACE (
                CASE WHEN employee_id % 50 = 0 THEN employee_id + 2000000000 ELSE employee_id END AS employee_id,
                CASE WHEN employee_id % 19 = 0 THEN 'moved.' || employee_id % 5 || '@x.org'
                     ELSE email END AS email,
                CASE WHEN employee_id % 13 = 0 THEN -1 ELSE salary END AS salary)
            FROM bad_employees),
        next_departments AS (SELECT * FROM bad_departments WHERE department_id % 7 <> 0),
        was AS ({before}), now AS ({after})
        SELECT table_name, constraint_name, now.violations - was.violations AS change
        FROM now JOIN was USING (table_name, constraint_name)
        WHERE now.violations <> was.violations"""


EMPLOYEE_CHECKS = {
    "check email_format": EMAIL_SQL,
    "check salary_positive": "salary >= 0",
    "check hire_date": "hire_date <= DATE '1999-06-30'",
    "check birth_date": "birth_date <= DATE '1981-06-30'",
    "not null first_name": "first_name IS NOT NULL",
}
# Per kind of request: table, key, and the checks its broken values can fail.
REQUEST_CHECKS = {
    "employee": (
        "bad_employees",
        "employee_id",
        {
            "first_name_length": "coalesce(length(first_name) BETWEEN 1 AND 100, false)",
            "email_format": EMAIL_SQL,
            "hire_date": "hire_date <= DATE '1999-06-30'",
            "salary": "salary > 0",
        },
    ),
    "department": ("bad_departments", "department_id", {"budget": "budget >= 0"}),
    "position": (
        "bad_positions",
        "position_id",
        {"range": "base_salary_max >= base_salary_min"},
    ),
    "project": (
        "bad_projects",
        "project_id",
        {"budget": "budget >= 0", "dates": "end_date >= start_date"},
    ),
    "vacation": ("bad_vacations", "vacation_id", {"dates": "end_date >= start_date"}),
    "salary_change": ("bad_salary_history", "salary_change_id", {"new_salary": "new_salary > 0"}),
    "raise": (
        "(SELECT employee_id, employee_id % 120 - 10 AS percent FROM employees)",
        "employee_id",
        {"percent": "percent > 0 AND percent <= 100"},
    ),
}


def _broken_list(checks: dict[str, str]) -> str:
    """Names of the broken checks, joined; CONCAT_WS skips the ones that hold."""
    parts = ", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in checks.items())
    return f"concat_ws(', ', {parts})"


MOVEMENT_SQL = """
    SELECT department_id, count(*) AS changes,
           CAST(count(*) FILTER (WHERE operation = 'INSERT')
                - count(*) FILTER (WHERE operation = 'DELETE') AS BIGINT) AS head_change,
           CAST(sum(CASE WHEN operation <> 'DELETE' THEN new_salary ELSE 0 END)
                - sum(CASE WHEN operation <> 'INSERT' THEN old_salary ELSE 0 END) AS DOUBLE)
               AS fund_change,
           CAST(max(new_salary) AS DOUBLE) AS highest_salary
    FROM changes LEFT JOIN employees USING (employee_id)
    GROUP BY department_id"""

BODIES: dict[str, str] = {
    "i0_load_tables": "\nUNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS row_count FROM {n}"
        for n in (
            "departments",
            "positions",
            "employees",
            "projects",
            "employee_projects",
            "salary_history",
            "vacations",
            "skills",
            "employee_skills",
            "audit_log",
        )
    )
    + "\nUNION ALL SELECT 'active_employees', count(*) FROM employees WHERE is_active",
    "i1_import_accepted": """
        SELECT row_no, first_name, last_name, email, hire_date,
               CAST(salary AS DOUBLE) AS salary, department_id, position_id, manager_id
        FROM csv_verdicts WHERE reason IS NULL""",
    "i1_import_rejected": """
        SELECT row_no AS row, 'Строка ' || CAST(row_no AS VARCHAR) || ': ' || reason AS error
        FROM csv_verdicts WHERE reason IS NOT NULL""",
    "i1_import_summary": """
        SELECT count(*) FILTER (WHERE reason IS NULL) AS success,
               count(reason) AS failed, count(*) AS total_processed
        FROM csv_verdicts""",
    "i2_append_new": """
        SELECT skill_name, category, skill_id FROM skills
        UNION ALL
        SELECT p_type, p_brand, p_partkey + 1000000 FROM part
        WHERE p_partkey % 50 <> 0 AND p_type NOT IN (SELECT skill_name FROM skills)
        QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) = 1""",
    "i2_refused": """
        WITH offered AS (
            SELECT CASE WHEN p_partkey % 50 <> 0 THEN p_type END AS skill_name,
                   p_partkey + 1000000 AS skill_id FROM part
            UNION ALL SELECT skill_name, skill_id FROM skills)
        SELECT CASE WHEN skill_name IS NULL THEN 'no key'
                    WHEN skill_name IN (SELECT skill_name FROM skills) THEN 'key is held'
                    WHEN turn > 1 THEN 'key is repeated' END AS refused, count(*) AS "rows"
        FROM (SELECT *, row_number() OVER (PARTITION BY skill_name ORDER BY skill_id) AS turn
              FROM offered)
        GROUP BY 1 HAVING refused IS NOT NULL""",
    "i3_sample_rows": """
        SELECT employee_id, last_name FROM employees
        ORDER BY md5('7:' || CAST(employee_id AS VARCHAR)), employee_id LIMIT 100""",
    "i4_report_records": """
        SELECT '{"department_id":' || CAST(d.department_id AS VARCHAR)
               || ',"department_name":"' || department_name
               || '","employee_count":' || CAST(count(employee_id) AS VARCHAR)
               || ',"total_salary":' || coalesce(CAST(sum(salary) AS VARCHAR), 'null') || '}'
               AS record
        FROM departments d
        LEFT JOIN (SELECT employee_id, salary,
                          CASE department_id WHEN 7 THEN 8 ELSE department_id END AS place
                   FROM employees) ON place = d.department_id
        GROUP BY d.department_id, department_name""",
    "q1_list_employees": f"""
        SELECT {EMPLOYEE_COLUMNS} FROM employees e
        WHERE department_id = 3 ORDER BY employee_id LIMIT 25 OFFSET 10""",
    "q1_page_summary": """
        SELECT count(*) AS total, CAST(10 AS INT) AS skip, CAST(25 AS INT) AS "limit",
               count(*) > 35 AS has_more
        FROM employees WHERE department_id = 3""",
    "q2_get_employee": f"SELECT {EMPLOYEE_COLUMNS} FROM employees e WHERE employee_id = 42",
    "q3_list_departments": """
        SELECT department_id, department_name, CAST(budget AS DOUBLE) AS budget,
               d.manager_id, location,
               CAST(coalesce(sum(salary), 0) AS DOUBLE) AS total_salary_budget,
               count(employee_id) AS employee_count
        FROM departments d
        LEFT JOIN (SELECT employee_id, department_id, salary FROM employees WHERE is_active)
             USING (department_id)
        GROUP BY ALL""",
    "q4_list_positions": """
        SELECT position_id, position_title, position_level,
               CAST(base_salary_min AS DOUBLE) AS base_salary_min,
               CAST(base_salary_max AS DOUBLE) AS base_salary_max
        FROM positions ORDER BY position_id LIMIT 10 OFFSET 5""",
    "q5_list_audit": """
        SELECT * REPLACE (strftime(changed_at, '%Y-%m-%d %H:%M:%S.%f') AS changed_at)
        FROM audit_log
        WHERE operation_type = 'INSERT'
        ORDER BY changed_at DESC, record_id, new_values LIMIT 50 OFFSET 10""",
    "s3_deep_page": """
        SELECT employee_id, project_id, CAST(hourly_rate AS DOUBLE) AS hourly_rate
        FROM employee_projects
        ORDER BY hourly_rate DESC NULLS FIRST, project_id, employee_id LIMIT 100 OFFSET 2000""",
    "s3_page_after": """
        SELECT employee_id, CAST(salary AS DOUBLE) AS salary
        FROM (SELECT *, row_number() OVER (ORDER BY salary DESC NULLS FIRST, employee_id) AS place
              FROM employees)
        WHERE place > (SELECT count(*) FROM employees WHERE salary > 120000 OR salary IS NULL)
        ORDER BY place LIMIT 100""",
    "q6_department_employees": f"""
        SELECT {EMPLOYEE_COLUMNS}, position_title, {full('boss')} AS manager_name
        FROM employees e
        LEFT JOIN positions p ON p.position_id = e.position_id
        LEFT JOIN employees boss ON boss.employee_id = e.manager_id
        WHERE e.department_id = 3""",
    "q7_search_employees": f"""
        SELECT e.employee_id, {full('e')} AS full_name, email, department_name, position_title,
               CAST(salary AS DOUBLE) AS salary, hire_date,
               coalesce((SELECT string_agg(DISTINCT skill_name, ', ' ORDER BY skill_name)
                         FROM employee_skills es JOIN skills USING (skill_id)
                         WHERE es.employee_id = e.employee_id), '') AS skills
        FROM employees e JOIN departments USING (department_id) JOIN positions USING (position_id)
        WHERE is_active""",
    "q7_search_by_skill": f"""
        SELECT e.employee_id, {full('e')} AS full_name, email, department_name, position_title,
               CAST(salary AS DOUBLE) AS salary, hire_date,
               (SELECT string_agg(DISTINCT skill_name, ', ' ORDER BY skill_name)
                FROM employee_skills es JOIN skills USING (skill_id)
                WHERE es.employee_id = e.employee_id) AS skills
        FROM employees e JOIN departments USING (department_id) JOIN positions USING (position_id)
        WHERE is_active AND salary BETWEEN 50000 AND 100000
          AND hire_date BETWEEN DATE '1993-01-01' AND DATE '1998-12-31'
          AND employee_id IN (SELECT employee_id FROM employee_skills
                              WHERE skill_id BETWEEN 1 AND 8)""",
    "q8_table_counts": "\nUNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS row_count FROM {n}"
        for n in (
            "departments",
            "positions",
            "employees",
            "skills",
            "projects",
            "employee_projects",
            "employee_skills",
        )
    )
    + "\nUNION ALL SELECT 'active_employees', count(*) FROM employees WHERE is_active",
    "q9_filtered_catalog": """
        SELECT p_partkey, p_name, p_retailprice, l_orderkey, l_linenumber, l_quantity
        FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE contains(p_name, 'ring') AND p_retailprice BETWEEN 900 AND 1000
          AND p_type = 'ECONOMY'""",
    "q10_filtered_orders": """
        SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, c_name
        FROM orders JOIN customer ON c_custkey = o_custkey
        WHERE o_orderstatus = 'F'
          AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'""",
    "q11_open_sets": """
        SELECT 'active_employees' AS open_set, employee_id AS id,
               CAST(NULL AS BIGINT) AS other_id
        FROM employees WHERE is_active
        UNION ALL SELECT 'open_projects', project_id, NULL FROM projects
                  WHERE status IN ('planning', 'active') AND end_date IS NULL
        UNION ALL SELECT 'approved_vacations', vacation_id, NULL FROM vacations
                  WHERE status = 'approved'
        UNION ALL SELECT 'recent_audit', record_id, CAST(strftime(changed_at, '%y%m%d%H%M%S%f') AS BIGINT)
                  FROM audit_log
                  WHERE changed_at > TIMESTAMP '2024-01-15 00:00:00'
        UNION ALL SELECT 'open_assignments', employee_id, project_id FROM employee_projects
                  WHERE end_date IS NULL
        UNION ALL SELECT 'certified_skills', employee_id, skill_id FROM employee_skills
                  WHERE certified""",
    "q12_token_search": """
        SELECT project_id, description FROM projects
        WHERE list_has_all(regexp_split_to_array(lower(description), '[^\\p{L}\\p{N}@._+-]+'),
                           ['работы', 'для', 'площадка', '15'])""",
    "s2_second_highest_paid": """
        SELECT employee_id, last_name, department_id, CAST(salary AS DOUBLE) AS salary
        FROM employees
        QUALIFY row_number() OVER (PARTITION BY department_id
                                   ORDER BY salary DESC, employee_id) = 2""",
    "v1_employee_details": _details_sql(),
    "v2_department_salary_report": f"""
        SELECT d.department_id, department_name, CAST(budget AS DOUBLE) AS budget,
               count(employee_id) AS total_employees,
               count(*) FILTER (WHERE is_active) AS active_employees,
               count(*) FILTER (WHERE NOT is_active) AS inactive_employees,
               CAST(coalesce(sum(salary) FILTER (WHERE is_active), 0) AS DOUBLE)
                   AS total_salary_fund,
               coalesce({mean('salary', 'is_active')}, 0) AS avg_salary,
               CAST(coalesce(min(salary) FILTER (WHERE is_active), 0) AS DOUBLE) AS min_salary,
               CAST(coalesce(max(salary) FILTER (WHERE is_active), 0) AS DOUBLE) AS max_salary,
               {share('coalesce(sum(salary) FILTER (WHERE is_active), 0)', 'budget')}
                   AS salary_to_budget_percentage,
               count(*) FILTER (WHERE is_active AND salary < base_salary_min)
                   AS below_min_salary,
               count(*) FILTER (WHERE is_active AND salary > base_salary_max)
                   AS above_max_salary
        FROM departments d
        LEFT JOIN (SELECT employee_id, department_id, salary, is_active, base_salary_min,
                          base_salary_max
                   FROM employees LEFT JOIN positions USING (position_id)) staff
               ON staff.department_id = d.department_id
        GROUP BY d.department_id, department_name, budget""",
    "v3_employee_hierarchy": TREE_SQL,
    "v4_project_resource_report": f"""
        WITH load AS (
            SELECT project_id, count(DISTINCT employee_id) AS members,
                   count(DISTINCT employee_id) FILTER (
                       WHERE end_date IS NULL OR end_date >= DATE '1999-06-30') AS present,
                   round(avg(participation_percentage), 1) AS mean_share,
                   CAST(sum(participation_percentage) AS BIGINT) AS share,
                   {COST_POINTS} AS points
            FROM employee_projects
            LEFT JOIN (SELECT employee_id, salary FROM employees) USING (employee_id)
            GROUP BY 1)
        SELECT p.project_id, project_name, start_date, end_date,
               CAST(p.budget AS DOUBLE) AS budget, status, department_name,
               {full('head')} AS project_manager, head.email AS project_manager_email,
               coalesce(members, 0) AS total_team_members,
               coalesce(present, 0) AS current_team_members,
               mean_share AS avg_participation_percentage,
               share AS total_participation_percentage,
               {from_points('coalesce(points, 0)')} AS estimated_monthly_cost,
               CASE WHEN end_date = start_date THEN 100
                    WHEN end_date IS NOT NULL
                    THEN round(greatest(0, least(100, (DATE '1999-06-30' - start_date) * 100.0
                                                      / (end_date - start_date))), 1)
                    END AS progress_percentage,
               CASE WHEN end_date < DATE '1999-06-30' THEN 'Просрочен'
                    WHEN end_date < DATE '1999-07-07' THEN 'Срочный'
                    WHEN status = 'active' THEN 'В работе' ELSE status END
                   AS project_status_detailed
        FROM projects p
        LEFT JOIN load l ON l.project_id = p.project_id
        LEFT JOIN departments d ON d.department_id = p.department_id
        LEFT JOIN employees head ON head.employee_id = project_manager_id""",
    "v5_skill_analytics": SKILL_SQL,
    "v6_vacation_calendar": f"""
        SELECT vacation_id, start_date, end_date, days_count, vacation_type, status,
               e.employee_id, {full('e')} AS employee_name, e.email AS employee_email,
               department_name, position_title, {full('a')} AS approved_by_name,
               a.email AS approved_by_email,
               CASE WHEN start_date > DATE '1999-06-30' THEN 'Запланирован'
                    WHEN end_date < DATE '1999-06-30' THEN 'Завершен'
                    ELSE 'Текущий' END AS vacation_timeline,
               CASE WHEN days_count > 30 THEN 'Длительный отпуск'
                    WHEN status = 'approved' AND end_date < DATE '1999-07-07'
                    THEN 'Скоро начало' ELSE 'Норма' END AS vacation_alert
        FROM vacations v
        JOIN employees e ON e.employee_id = v.employee_id
        LEFT JOIN departments d ON d.department_id = e.department_id
        LEFT JOIN positions p ON p.position_id = e.position_id
        LEFT JOIN employees a ON a.employee_id = v.approved_by
        WHERE status = 'approved' OR status = 'taken'""",
    "v7_salary_change_analysis": f"""
        WITH dated AS (
            SELECT *, CAST(date_trunc('month', change_date) AS DATE) AS m,
                   new_salary - old_salary AS rise
            FROM salary_history),
        reasons AS (
            SELECT m, string_agg(change_reason, ', ' ORDER BY place) AS names
            FROM (SELECT m, change_reason,
                         row_number() OVER (PARTITION BY m
                                            ORDER BY count(*) DESC, change_reason) AS place
                  FROM dated GROUP BY 1, 2)
            WHERE place <= 3 GROUP BY 1),
        places AS (
            SELECT m, string_agg(department_name, ', ' ORDER BY place) AS names
            FROM (SELECT m, department_name,
                         row_number() OVER (PARTITION BY m
                                            ORDER BY count(*) DESC, department_name) AS place
                  FROM dated JOIN employees USING (employee_id)
                  JOIN departments USING (department_id) GROUP BY 1, 2)
            WHERE place <= 3 GROUP BY 1)
        SELECT m AS change_month,
               rpad(strftime(m, '%B'), 9, ' ') || strftime(m, ' %Y') AS month_name,
               count(DISTINCT employee_id) AS employees_with_changes,
               count(*) AS total_changes,
               round(avg(CAST(rise AS DOUBLE) * 100 / nullif(CAST(old_salary AS DOUBLE), 0)), 2)
                   AS avg_percentage_increase,
               {mean('rise')} AS avg_amount_increase,
               CAST(sum(rise) AS DOUBLE) AS total_salary_increase,
               any_value(r.names) AS top_reasons, any_value(p.names) AS top_departments
        FROM dated LEFT JOIN reasons r USING (m) LEFT JOIN places p USING (m)
        GROUP BY m""",
    "v8_hr_dashboard": f"""
        SELECT s.*, d.*, w.active_projects, l.employees_on_vacation_today,
               {share('CAST(total_salary_fund AS DECIMAL(30,2))',
                       'CAST(total_company_budget AS DECIMAL(30,2))')}
                   AS salary_to_budget_percentage_company
        FROM (SELECT count(*) FILTER (WHERE is_active) AS total_active_employees,
                     {mean('salary', 'is_active')} AS company_avg_salary,
                     CAST(sum(salary) FILTER (WHERE is_active) AS DOUBLE) AS total_salary_fund,
                     count(*) FILTER (WHERE year(hire_date) = 1999) AS hires_this_year,
                     count(*) FILTER (WHERE year(hire_date) = 1999 AND month(hire_date) = 6)
                         AS hires_this_month,
                     count(*) FILTER (WHERE NOT is_active AND year(updated_at) = 1999)
                         AS terminations_this_year
              FROM employees) s,
             (SELECT count(*) AS total_departments,
                     CAST(sum(budget) AS DOUBLE) AS total_company_budget FROM departments) d,
             (SELECT count(*) FILTER (WHERE status = 'active') AS active_projects
              FROM projects) w,
             (SELECT count(*) AS employees_on_vacation_today FROM vacations
              WHERE status = 'approved'
                AND DATE '1999-06-30' BETWEEN start_date AND end_date) l""",
    "v9_employee_info": f"""
        SELECT e.employee_id, {full('e')} AS full_name, e.email, department_name,
               {full('boss')} AS manager_name
        FROM employees e
        LEFT JOIN departments d ON d.department_id = e.department_id
        LEFT JOIN employees boss ON boss.employee_id = e.manager_id""",
    "v10_department_budget": """
        SELECT department_id, department_name, CAST(budget AS DOUBLE) AS budget,
               CAST(sum(salary) AS DOUBLE) AS total_salary
        FROM departments
        LEFT JOIN (SELECT department_id, salary FROM employees WHERE is_active)
             USING (department_id)
        GROUP BY 1, 2, 3""",
    "r1_subordinates": BELOW_SQL,
    "r2_employee_manager_list": f"""
        SELECT e.employee_id, {full('e')} AS employee_name, e.position_id, position_title,
               department_name, {full('boss')} AS manager_name, e.manager_id
        FROM employees e
        LEFT JOIN employees boss ON boss.employee_id = e.manager_id
        LEFT JOIN departments d ON d.department_id = e.department_id
        LEFT JOIN positions p ON p.position_id = e.position_id""",
    "r3_hierarchy_sample": f"""
        SELECT {full('e')} AS employee, position_title, department_name,
               CASE WHEN e.manager_id IS NULL THEN 'Нет руководителя'
                    ELSE {full('boss')} END AS manager
        FROM employees e
        LEFT JOIN employees boss ON boss.employee_id = e.manager_id
        LEFT JOIN departments d ON d.department_id = e.department_id
        LEFT JOIN positions p ON p.position_id = e.position_id
        ORDER BY e.department_id, e.salary DESC, e.employee_id LIMIT 10""",
    "r4_department_statistics": f"""
        SELECT department_name, count(salary) AS total_employees,
               CAST(coalesce(sum(salary), 0) AS DOUBLE) AS total_salary_fund,
               coalesce({mean('salary')}, 0) AS avg_salary,
               CAST(budget AS DOUBLE) AS budget
        FROM departments
        LEFT JOIN (SELECT department_id, salary FROM employees WHERE is_active)
             USING (department_id)
        GROUP BY department_id, department_name, budget""",
    "r5_department_payroll": f"""
        SELECT department_id, department_name, count(salary) AS employee_count,
               CAST(sum(salary) AS DOUBLE) AS total_salary, {mean('salary')} AS avg_salary
        FROM departments
        LEFT JOIN (SELECT CASE department_id WHEN 7 THEN 8 ELSE department_id END
                              AS department_id, salary
                   FROM employees) USING (department_id)
        GROUP BY 1, 2""",
    "r6_employee_statistics": f"""
        WITH sums AS (
            SELECT CASE WHEN grouping(department_id) = 1 THEN 'company' ELSE 'department' END
                       AS scope,
                   department_id, count(*) AS total_employees,
                   count(*) FILTER (WHERE is_active) AS active_employees,
                   CAST(coalesce(sum(salary) FILTER (WHERE is_active), 0) AS DOUBLE)
                       AS total_salary_budget,
                   coalesce({mean('salary', 'is_active')}, 0) AS avg_salary
            FROM employees GROUP BY GROUPING SETS ((department_id), ()))
        SELECT scope, s.department_id, department_name, total_employees, active_employees,
               total_salary_budget, avg_salary
        FROM sums s LEFT JOIN departments d ON d.department_id = s.department_id""",
    "r7_project_load": """
        SELECT project_id, project_name, count(DISTINCT employee_id) AS total_employees,
               CAST(coalesce(sum(participation_percentage), 0) AS BIGINT) AS allocation_sum,
               status
        FROM projects
        LEFT JOIN (SELECT project_id, employee_id, participation_percentage
                   FROM employee_projects) USING (project_id)
        GROUP BY project_id, project_name, status""",
    "f1_department_fund": """
        SELECT department_id, CAST(coalesce(sum(salary), 0) AS DOUBLE) AS total_fund
        FROM departments
        LEFT JOIN (SELECT department_id, salary FROM employees WHERE is_active)
             USING (department_id)
        GROUP BY 1""",
    "f2_check_hire": """
        SELECT e.employee_id AS candidate_id,
               CASE WHEN e.employee_id % 30 = 0 THEN 99 ELSE e.department_id END
                   AS department_id,
               CAST(e.salary * 12 AS DOUBLE) AS salary,
               CASE WHEN e.employee_id % 30 = 0 THEN NULL
                    ELSE fund + e.salary * 12 <= budget * 0.7 END AS within_budget
        FROM employees e
        JOIN departments d ON d.department_id = e.department_id
        JOIN (SELECT department_id, sum(salary) AS fund FROM employees
              WHERE is_active GROUP BY 1) f ON f.department_id = e.department_id""",
    "f3_raise_salaries": f"""
        SELECT employee_id, {full()} AS employee_name, CAST(salary AS DOUBLE) AS old_salary,
               CAST(round(salary * 1.075, 2) AS DOUBLE) AS new_salary,
               CAST(round(salary * 1.075, 2) - salary AS DOUBLE) AS increase_amount
        FROM employees WHERE department_id = 3 AND is_active""",
    "f3_raise_job": """
        WITH staff AS (
            SELECT employee_id, department_id, salary, round(salary * 1.075, 2) AS raised
            FROM employees WHERE is_active AND department_id BETWEEN 3 AND 6),
        over AS (
            SELECT s.department_id,
                   sum(raised) > 0.7 * any_value(CAST(CASE WHEN d.department_id % 3 = 0
                       THEN budget / 10000 ELSE budget * 100 END AS DECIMAL(15,2))) AS broken
            FROM staff s JOIN departments d ON d.department_id = s.department_id
            GROUP BY s.department_id)
        SELECT employee_id, CASE WHEN NOT broken THEN CAST(salary AS DOUBLE) END AS old_salary,
               CASE WHEN NOT broken THEN CAST(raised AS DOUBLE) END AS new_salary,
               CASE WHEN NOT broken THEN 'Повышение зарплаты отделу '
                    || CAST(s.department_id AS VARCHAR) || ' на 7.50%' END AS change_reason,
               CASE WHEN broken THEN 'refused' ELSE 'raised' END AS outcome
        FROM staff s JOIN over USING (department_id)""",
    "f4_manager_subordinates": REPORTS_SQL,
    "f5_project_cost": f"""
        WITH costs AS (
            SELECT p.project_id, CAST(p.budget AS DOUBLE) AS budget,
                   coalesce(points, 0) AS people,
                   CAST(p.budget * 120000 AS HUGEINT) - coalesce(points, 0) AS other
            FROM projects p
            LEFT JOIN (SELECT project_id, {COST_POINTS} AS points
                       FROM employee_projects ep
                       JOIN (SELECT employee_id, salary FROM employees WHERE is_active)
                            USING (employee_id)
                       WHERE end_date IS NULL OR end_date >= DATE '1999-06-30'
                       GROUP BY 1) c ON c.project_id = p.project_id)
        SELECT project_id, 'Стоимость человеческих ресурсов' AS cost_component,
               {from_points('people')} AS amount,
               round(people / nullif(budget, 0) / 1200, 2) AS percentage_of_budget
        FROM costs
        UNION ALL
        SELECT project_id, 'Прочие расходы', {from_points('other')},
               round(other / nullif(budget, 0) / 1200, 2)
        FROM costs""",
    "f6a_new_hires": f"WITH {HIRES_BY_MONTH} {NEW_HIRES}",
    "f6b_avg_hire_salary": f"WITH {HIRES_BY_MONTH} {HIRE_PAY}",
    "f6c_turnover": TURNOVER,
    "f6d_department_utilization": UTILIZATION,
    "f6_hr_statistics": f"""WITH {HIRES_BY_MONTH}
        {NEW_HIRES} UNION ALL {HIRE_PAY} UNION ALL {TURNOVER} UNION ALL {UTILIZATION}""",
    "f8_vacation_days": """
        WITH leave AS (
            SELECT employee_id, vacation_type,
                   CASE WHEN status = 'taken' AND year(start_date) = 1999
                        THEN days_count ELSE 0 END AS taken,
                   CASE WHEN status = 'approved' AND year(start_date) = 1999
                             AND start_date > DATE '1999-06-30'
                        THEN days_count ELSE 0 END AS planned
            FROM vacations WHERE status IN ('taken', 'approved')),
        typed AS (
            SELECT * FROM leave
            UNION ALL SELECT employee_id, 'total', taken, planned FROM leave)
        SELECT employee_id, vacation_type, CAST(sum(taken) AS BIGINT) AS days_taken,
               CAST(sum(planned) AS BIGINT) AS days_planned,
               CAST(28 - sum(taken + planned) AS BIGINT) AS days_remaining,
               CAST(28 AS INT) AS total_entitled
        FROM typed GROUP BY 1, 2""",
    "f9_tenure": f"""
        SELECT employee_id, {full()} AS full_name, hire_date,
               CAST(floor((DATE '1999-06-30' - hire_date) / 365) AS INT) AS tenure_years
        FROM employees""",
    "t1_audit_diff": AUDIT_SQL,
    "t2_salary_changes": """
        SELECT employee_id, CAST(b.salary AS DOUBLE) AS old_salary,
               CAST(a.salary AS DOUBLE) AS new_salary, DATE '1999-06-30' AS change_date,
               'salary_adjustment' AS change_reason, CAST(1 AS BIGINT) AS changed_by,
               CASE WHEN a.salary > b.salary THEN 'kept' ELSE 'rejected' END AS outcome
        FROM before_rows b JOIN after_rows a USING (employee_id)
        WHERE a.salary <> b.salary""",
    "t3_touch": f"""
        SELECT a.employee_id, CAST(a.salary AS DOUBLE) AS salary, a.department_id,
               a.position_id,
               CASE WHEN b.employee_id IS NOT NULL
                         AND ({ANY_CHANGE.replace(" OR b.updated_at IS DISTINCT FROM a.updated_at", "")})
                    THEN DATE '1999-07-01' ELSE a.updated_at END AS updated_at
        FROM after_rows a LEFT JOIN before_rows b ON b.employee_id = a.employee_id""",
    "t4_reassign_department_heads": """
        WITH moves AS (
            SELECT a.department_id, a.employee_id,
                   row_number() OVER (PARTITION BY a.department_id
                                      ORDER BY changed_on DESC, a.employee_id DESC) AS place
            FROM after_rows a
            JOIN positions p ON p.position_id = a.position_id
            LEFT JOIN before_rows b ON b.employee_id = a.employee_id
            WHERE position_level IN ('manager', 'director', 'executive')
              AND (b.employee_id IS NULL OR b.position_id <> a.position_id
                   OR b.department_id <> a.department_id))
        SELECT d.department_id, department_name, employee_id AS manager_id,
               CASE WHEN employee_id IS NULL THEN DATE '1998-06-30' ELSE DATE '1999-06-30' END
                   AS updated_at,
               employee_id IS NOT NULL AS reassigned
        FROM departments d
        LEFT JOIN (SELECT * FROM moves WHERE place = 1) m ON m.department_id = d.department_id""",
    "t5_hierarchy_violations": LOOP_SQL,
    "t6_vacation_days_check": """
        SELECT vacation_id, employee_id, start_date, end_date, days_count,
               CASE WHEN end_date - start_date >= 60 THEN 'rejected' ELSE 'kept' END AS outcome
        FROM vacations""",
    "t7_project_status": """
        SELECT project_id, start_date, end_date,
               CASE WHEN end_date < DATE '1999-06-30' THEN 'completed'
                    WHEN status = 'planning' AND start_date <= DATE '1999-06-30' THEN 'active'
                    ELSE status END AS status
        FROM projects""",
    "t7b_budget_violations": """
        SELECT * FROM (
            SELECT e.employee_id, e.department_id,
                   CAST(coalesce((SELECT sum(o.salary) FROM employees o
                                  WHERE o.department_id = e.department_id AND o.is_active
                                    AND o.employee_id <> e.employee_id), 0) + e.salary
                        AS DOUBLE) AS fund,
                   CAST(budget * 0.7 AS DOUBLE) AS fund_limit
            FROM employees e JOIN departments d ON d.department_id = e.department_id)
        WHERE fund > fund_limit""",
    "t7c_department_stats_after": f"""
        WITH pairs AS (
            SELECT b.department_id AS old_place, a.department_id AS new_place
            FROM before_rows b FULL JOIN after_rows a ON a.employee_id = b.employee_id
            WHERE a.salary IS DISTINCT FROM b.salary
               OR a.department_id IS DISTINCT FROM b.department_id),
        touched AS (
            SELECT old_place AS department_id FROM pairs WHERE old_place IS NOT NULL
            UNION SELECT new_place FROM pairs WHERE new_place IS NOT NULL)
        SELECT t.department_id, count(a.employee_id) AS employees,
               CAST(coalesce(sum(salary) FILTER (WHERE is_active), 0) AS DOUBLE) AS fund,
               {mean('salary', 'is_active')} AS avg_salary,
               CAST(min(salary) FILTER (WHERE is_active) AS DOUBLE) AS min_salary,
               CAST(max(salary) FILTER (WHERE is_active) AS DOUBLE) AS max_salary
        FROM touched t LEFT JOIN after_rows a ON a.department_id = t.department_id
        GROUP BY 1""",
    "t8_fill_department_heads": """
        SELECT department_id, department_name, CAST(budget AS DOUBLE) AS budget,
               employee_id AS manager_id, location
        FROM departments
        LEFT JOIN (SELECT department_id, employee_id FROM employees
                   QUALIFY row_number() OVER (PARTITION BY department_id
                                              ORDER BY salary DESC, employee_id) = 1)
             USING (department_id)""",
    "t9_fill_managers": """
        WITH heads AS (
            SELECT department_id, employee_id AS head FROM employees
            QUALIFY row_number() OVER (PARTITION BY department_id
                                       ORDER BY salary DESC, employee_id) = 1)
        SELECT e.employee_id, e.department_id,
               CASE WHEN e.employee_id % 3 <> 0 AND e.manager_id IS NOT NULL THEN e.manager_id
                    WHEN e.employee_id <> h.head THEN h.head
                    WHEN e.department_id > 1
                    THEN (SELECT head FROM heads WHERE department_id = 1) END AS manager_id
        FROM employees e LEFT JOIN heads h ON h.department_id = e.department_id""",
    "t9b_assign_positions": f"""
        WITH doubled AS (
            SELECT employee_id, department_id, position_id, salary * 2 AS salary FROM employees)
        SELECT employee_id, CAST(salary AS DOUBLE) AS salary,
               CASE WHEN employee_id % 4 = 0 THEN position_id
                    ELSE CAST({POSITION_BY_SALARY} AS BIGINT) END AS position_id
        FROM doubled JOIN {NAMED_DEPARTMENTS} USING (department_id)""",
    "t10_assign_skills": """
        WITH slots AS (
            SELECT skill_id, row_number() OVER (ORDER BY skill_id) - 1 AS slot,
                   count(*) OVER () AS choices
            FROM skills WHERE category IN ('ECONOMY', 'PROMO'))
        SELECT e.employee_id, s.skill_id,
               CASE WHEN salary >= 150000 THEN 'expert' WHEN salary >= 100000 THEN 'advanced'
                    WHEN salary >= 70000 THEN 'intermediate' ELSE 'beginner' END
                   AS proficiency_level,
               salary >= 100000 AS certified
        FROM employees e
        JOIN departments d ON d.department_id = e.department_id
        JOIN slots s ON (slot - e.employee_id % choices + choices) % choices < 5
        WHERE (contains(department_name, '_1') OR contains(department_name, '_20'))
          AND NOT EXISTS (SELECT 1 FROM employee_skills es
                          WHERE es.employee_id = e.employee_id AND es.skill_id = s.skill_id)""",
    "t11_assign_projects": """
        WITH slots AS (
            SELECT *, row_number() OVER (PARTITION BY department_id
                                         ORDER BY project_id) - 1 AS slot,
                   count(*) OVER (PARTITION BY department_id) AS choices
            FROM projects)
        SELECT e.employee_id, project_id,
               CASE WHEN e.employee_id = project_manager_id THEN 'Руководитель проекта'
                    WHEN salary >= 150000 THEN 'Ведущий специалист'
                    WHEN salary >= 100000 THEN 'Старший специалист'
                    ELSE 'Специалист' END AS role_in_project,
               CAST(70 + (e.employee_id * 7 + project_id * 13) % 31 AS INT)
                   AS participation_percentage,
               start_date + CAST((e.employee_id + project_id) % 30 AS INT) AS start_date
        FROM employees e JOIN slots s ON s.department_id = e.department_id
        WHERE (slot = e.employee_id % choices OR slot = (e.employee_id + 1) % choices)
          AND NOT EXISTS (SELECT 1 FROM employee_projects ep
                          WHERE ep.employee_id = e.employee_id
                            AND ep.project_id = s.project_id)""",
    "t12_apply_updates": """
        SELECT employee_id,
               CASE WHEN employee_id % 6 = 0 AND employee_id % 90 <> 0
                    THEN CASE WHEN employee_id % 12 = 0 THEN phone || '0' END
                    ELSE phone END AS phone,
               CAST(CASE WHEN employee_id % 6 <> 0 OR employee_id % 90 = 0 THEN salary
                         WHEN employee_id % 18 = 0 THEN salary * 2 + 2
                         ELSE salary * 2 + 1 END AS DOUBLE) AS salary,
               CASE WHEN employee_id % 6 = 0 AND employee_id % 90 <> 0
                    THEN department_id % 25 + 1 ELSE department_id END AS department_id,
               'employee' AS outcome
        FROM employees
        UNION ALL
        SELECT employee_id + 100000000,
               CASE WHEN (employee_id + 100000000) % 12 = 0 THEN phone || '0' END,
               CAST(salary * 2 + n AS DOUBLE), department_id % 25 + 1, 'unknown'
        FROM employees, (SELECT unnest([1, 2]) AS n) WHERE employee_id % 90 = 0""",
    "t12_checked_updates": """
        WITH RECURSIVE asked AS (
            SELECT e.*, n,
                   CASE WHEN e.employee_id % 12 = 0 THEN -1 WHEN e.employee_id % 6 = 0 THEN e.salary + 1
                        WHEN e.employee_id % 6 = 1 THEN e.salary + 30000 ELSE e.salary END AS new_salary,
                   CASE WHEN e.employee_id % 18 = 0 THEN 99 WHEN e.employee_id % 6 = 0 THEN 3
                        ELSE e.department_id END AS new_place,
                   CASE WHEN e.employee_id % 30 = 0 THEN 'same@company.com'
                        WHEN e.employee_id % 6 = 0 THEN 'p.' || e.email
                        WHEN e.employee_id % 6 >= 4 THEN coalesce(x.email, e.email) ELSE e.email END AS new_email,
                   CASE WHEN e.employee_id % 10 = 1 AND 6 * e.employee_id <= n THEN 6 * e.employee_id
                        WHEN e.employee_id % 10 = 2 THEN e.employee_id + 1
                        WHEN e.employee_id % 10 = 3 THEN e.employee_id - 1 ELSE e.manager_id END AS new_manager
            FROM employees e
            LEFT JOIN employees x ON x.employee_id = e.employee_id + 1,
                 (SELECT max(employee_id) AS n FROM employees)),
        row_rules AS (
            SELECT employee_id, 'check salary_positive' AS rule FROM asked WHERE new_salary < 0
            UNION ALL SELECT employee_id, 'foreign key department_id' FROM asked WHERE new_place = 99
            UNION ALL SELECT employee_id, 'foreign key manager_id' FROM asked WHERE new_manager > n),
        wishes AS (
            SELECT *, count(*) OVER (PARTITION BY new_email) > 1 AS shared FROM asked
            WHERE new_email <> email AND employee_id NOT IN (SELECT employee_id FROM row_rules)),
        out_first AS (
            FROM row_rules UNION ALL SELECT employee_id, 'unique email' FROM wishes WHERE shared),
        waits AS (
            SELECT w.employee_id, o.employee_id AS owner,
                   o.employee_id NOT IN (SELECT employee_id FROM wishes WHERE NOT shared) AS kept
            FROM wishes w JOIN employees o ON o.email = w.new_email AND o.employee_id <> w.employee_id
            WHERE NOT shared),
        no_address AS (
            SELECT employee_id FROM waits WHERE kept
            UNION SELECT w.employee_id FROM waits w JOIN no_address f ON f.employee_id = w.owner),
        out_second AS (FROM out_first UNION ALL SELECT employee_id, 'unique email' FROM no_address),
        -- Reports of m are 6m to 6m + 5. Asking for an own report closes a loop, and so does
        -- the second of two who ask for each other, if the first got it.
        loops AS (
            SELECT employee_id, 'reporting loop' AS rule FROM asked
            WHERE employee_id NOT IN (SELECT employee_id FROM out_second)
              AND (employee_id % 10 = 1 AND 6 * employee_id <= n
                   OR employee_id % 10 = 3
                      AND employee_id - 1 NOT IN (SELECT employee_id FROM out_second))),
        out_third AS (FROM out_second UNION ALL FROM loops),
        pays AS (
            SELECT employee_id, new_place,
                   new_salary - CASE WHEN is_active AND new_place = department_id THEN salary ELSE 0 END AS need,
                   is_active, row_number() OVER (ORDER BY employee_id) AS t
            FROM asked
            WHERE (new_salary <> salary OR new_place <> department_id)
              AND employee_id NOT IN (SELECT employee_id FROM out_third)),
        walk AS (
            SELECT CAST(0 AS BIGINT) AS t, CAST(NULL AS BIGINT) AS employee_id, false AS over,
                   (SELECT MAP(list(department_id), list(CAST(room AS DECIMAL(20,3)))) FROM payroll_rooms) AS rooms
            UNION ALL
            SELECT p.t, p.employee_id, need > rooms[new_place],
                   CASE WHEN need > rooms[new_place] OR NOT is_active OR need < 0 THEN rooms
                        ELSE map_concat(rooms, MAP([new_place], [CAST(rooms[new_place] - need AS DECIMAL(20,3))])) END
            FROM walk w JOIN pays p ON p.t = w.t + 1),
        out_fourth AS (
            FROM out_third UNION ALL SELECT employee_id, 'payroll over budget' FROM walk WHERE over),
        -- Whoever was refused since keeps an address that others may wait for.
        no_address_either AS (
            SELECT employee_id FROM waits
            WHERE kept OR owner IN (SELECT employee_id FROM out_fourth)
            UNION SELECT w.employee_id FROM waits w JOIN no_address_either f ON f.employee_id = w.owner),
        out_last AS (
            FROM out_fourth UNION ALL
            SELECT employee_id, 'unique email' FROM no_address_either
            WHERE employee_id NOT IN (SELECT employee_id FROM out_fourth)),
        judged AS (
            SELECT employee_id, string_agg(DISTINCT rule, ', ' ORDER BY rule) AS broken FROM out_last GROUP BY 1)
        SELECT employee_id, CASE WHEN broken IS NULL THEN new_email ELSE email END AS email,
               CAST(CASE WHEN broken IS NULL THEN new_salary ELSE salary END AS DOUBLE) AS salary,
               CASE WHEN broken IS NULL THEN new_place ELSE department_id END AS department_id,
               CASE WHEN broken IS NULL THEN new_manager ELSE manager_id END AS manager_id, broken
        FROM asked LEFT JOIN judged USING (employee_id)""",
    "t13_delete_employees": """
        WITH gone AS (
            SELECT employee_id FROM employees
            WHERE NOT is_active
              AND employee_id NOT IN (SELECT project_manager_id FROM projects)
              AND employee_id NOT IN (SELECT changed_by FROM salary_history))
        SELECT 'employees' AS table_name, employee_id AS id,
               CASE WHEN manager_id NOT IN (FROM gone) THEN manager_id END AS other_id
        FROM employees WHERE employee_id NOT IN (FROM gone)
        UNION ALL SELECT 'employee_projects', employee_id, project_id
        FROM employee_projects WHERE employee_id NOT IN (FROM gone)
        UNION ALL SELECT 'salary_history', salary_change_id, employee_id
        FROM salary_history WHERE employee_id NOT IN (FROM gone)
        UNION ALL SELECT 'vacations', vacation_id,
                         CASE WHEN approved_by NOT IN (FROM gone) THEN approved_by END
        FROM vacations WHERE employee_id NOT IN (FROM gone)
        UNION ALL SELECT 'employee_skills', employee_id, skill_id
        FROM employee_skills WHERE employee_id NOT IN (FROM gone)
        UNION ALL SELECT 'audit_log', change_id,
                         CASE WHEN employee_id NOT IN (FROM gone) THEN employee_id END
        FROM changes""",
    "t13_blocked_deletes": """
        SELECT employee_id, 'projects.project_manager_id' AS held_by FROM employees
        WHERE NOT is_active
          AND employee_id IN (SELECT project_manager_id FROM projects)
        UNION ALL
        SELECT employee_id, 'salary_history.changed_by' FROM employees
        WHERE NOT is_active AND employee_id IN (SELECT changed_by FROM salary_history)""",
    "t14_validate_new_employees": """
        WITH requests AS (
            SELECT employee_id AS request_no, first_name,
                   CASE WHEN employee_id % 5 = 0 THEN email
                        WHEN employee_id % 4 = 0
                        THEN 'same.' || CAST(employee_id % 7 AS VARCHAR) || '@company.com'
                        ELSE 'new.' || email END AS email,
                   CASE WHEN employee_id % 8 = 0 THEN 77 WHEN employee_id % 9 = 0 THEN 0
                        ELSE department_id END AS department_id,
                   CASE WHEN employee_id % 11 = 0 THEN manager_id + 100000000
                        ELSE manager_id END AS manager_id, salary
            FROM employees),
        faults AS (
            SELECT *, CASE WHEN department_id = 77 THEN 'Отдел не существует'
                           WHEN manager_id > 100000000 THEN 'Руководитель не существует'
                      END AS fault
            FROM requests),
        turns AS (
            SELECT request_no AS no, email, department_id, salary AS pay FROM faults WHERE fault IS NULL),
        taken_in AS ("""
    + taken_in("turns")
    + f""")
        SELECT request_no, first_name, f.email, CAST(salary AS DOUBLE) AS salary, department_id, manager_id,
               CASE WHEN EXISTS (SELECT 1 FROM employees e WHERE e.email = f.email)
                      OR EXISTS (SELECT 1 FROM taken_in o
                                 WHERE o.email = f.email AND NOT taken AND NOT over AND o.no < f.request_no)
                    THEN 'Email уже используется'
                    ELSE coalesce(fault, CASE WHEN over THEN '{OVER_BUDGET}' END) END AS error
        FROM faults f LEFT JOIN taken_in t ON t.no = f.request_no""",
    "t15_create_departments": """
        SELECT department_id, department_name, CAST(budget AS DOUBLE) AS budget, manager_id,
               location
        FROM departments
        UNION ALL
        SELECT s_suppkey + 101, name, CAST(CAST(s_acctbal + 2000 AS DECIMAL(15,2)) AS DOUBLE),
               NULL, NULL
        FROM (SELECT *, CASE WHEN s_suppkey % 4 = 0
                             THEN 'NATION_' || CAST(s_nationkey AS VARCHAR)
                             ELSE s_name END AS name FROM supplier)
        WHERE name NOT IN (SELECT department_name FROM departments)
        QUALIFY row_number() OVER (PARTITION BY name ORDER BY s_suppkey) = 1""",
    "c_constraint_report": _constraint_sql(),
    "c1_check_violations": f"""
        SELECT employee_id, {_broken_list(EMPLOYEE_CHECKS)} AS broken
        FROM bad_employees WHERE {_broken_list(EMPLOYEE_CHECKS)} <> ''""",
    "c2_duplicate_keys": """
        SELECT employee_id, skill_id, count(*) AS held FROM bad_employee_skills
        GROUP BY 1, 2 HAVING count(*) > 1""",
    "c3_orphans": """
        SELECT skill_id, count(*) AS held FROM bad_employee_skills
        WHERE skill_id NOT IN (SELECT skill_id FROM bad_skills) GROUP BY 1""",
    "c3_orphan_rows": """
        SELECT employee_id, manager_id FROM bad_employees
        WHERE manager_id IS NOT NULL
          AND manager_id NOT IN (SELECT employee_id FROM bad_employees)""",
    "c4_missing_values": "\nUNION ALL ".join(_required_lines("employees")),
    "c5_partial_unique": """
        SELECT phone, count(*) AS held FROM employees
        WHERE phone IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
    "c5_open_assignments": """
        SELECT o_custkey + 1 AS employee_id, l_suppkey + 1 AS project_id, count(*) AS held
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_returnflag = 'N' GROUP BY 1, 2 HAVING count(*) > 1""",
    "c_change_report": _change_sql(),
    "c6_request_errors": "\nUNION ALL ".join(
        f"SELECT '{kind}' AS kind, {key} AS id, {_broken_list(checks)} AS errors "
        f"FROM {source} WHERE {_broken_list(checks)} <> ''"
        for kind, (source, key, checks) in REQUEST_CHECKS.items()
    ),
    "x1_stream_audit": """
        SELECT * REPLACE (strftime(changed_at, '%Y-%m-%d %H:%M:%S.%f') AS changed_at)
        FROM audit_log""",
    "x2_stream_history": """
        SELECT change_id AS salary_change_id, employee_id,
               CAST(old_salary AS DOUBLE) AS old_salary,
               CAST(new_salary AS DOUBLE) AS new_salary,
               CAST(changed_at AS DATE) AS change_date,
               'salary_adjustment' AS change_reason, CAST(1 AS BIGINT) AS changed_by
        FROM changes WHERE operation = 'UPDATE' AND new_salary > old_salary""",
    "x3_stream_department_figures": """
        WITH last AS (
            SELECT employee_id AS person, operation, new_salary FROM changes
            QUALIFY row_number() OVER (PARTITION BY employee_id
                                       ORDER BY changed_at DESC, change_id DESC) = 1),
        pay AS (
            SELECT department_id, CASE WHEN operation IS NULL THEN salary
                                       WHEN operation <> 'DELETE' THEN new_salary END AS pay
            FROM employees LEFT JOIN last ON person = employee_id WHERE is_active)
        SELECT department_id, count(pay) AS paid, CAST(sum(pay) AS DOUBLE) AS fund,
               round(CAST(sum(pay) AS DOUBLE) / count(pay), 2) AS avg_salary,
               CAST(min(pay) AS DOUBLE) AS min_salary
        FROM pay GROUP BY department_id""",
    "x3_stream_department_movement": MOVEMENT_SQL,
}

for _name in ("t1_audit_diff", "t2_salary_changes", "t3_touch"):
    BODIES[f"{_name[:2]}_few_changes"] = BODIES[_name]

ORACLE: dict[str, str] = {name: with_tables(body) for name, body in BODIES.items()}
