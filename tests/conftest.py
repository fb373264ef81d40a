from __future__ import annotations

import os
import sys
from datetime import date
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from rosterlake.session import build_session  # noqa: E402
from rosterlake.sources.tables import SCHEMAS  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

DEFAULTS = {
    "departments": {"department_name": "Отдел", "budget": Decimal(1000)},
    "positions": {
        "position_title": "Должность",
        "position_level": "junior",
        "base_salary_min": Decimal(0),
        "base_salary_max": Decimal(100),
    },
    "employees": {
        "first_name": "Имя",
        "last_name": "Фамилия",
        "email": "a@company.com",
        "hire_date": date(2020, 1, 1),
        "salary": Decimal(100),
        "department_id": 1,
        "position_id": 1,
        "is_active": True,
    },
    "projects": {
        "project_name": "Проект",
        "department_id": 1,
        "start_date": date(2020, 1, 1),
        "budget": Decimal(1000),
        "status": "active",
        "project_manager_id": 1,
    },
    "employee_projects": {
        "employee_project_id": 1,
        "role_in_project": "member",
        "participation_percentage": 100,
        "start_date": date(2020, 1, 1),
    },
    "salary_history": {
        "salary_change_id": 1,
        "change_date": date(2020, 1, 1),
        "change_reason": "raise",
        "changed_by": 1,
    },
    "vacations": {"vacation_id": 1, "vacation_type": "annual", "status": "approved"},
    "skills": {"skill_name": "SQL", "category": "databases"},
    "employee_skills": {"employee_skill_id": 1, "proficiency_level": "expert"},
    "audit_log": {"table_name": "employees", "operation_type": "UPDATE"},
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(folder),
            "spark.sql.warehouse.dir": str(folder / "warehouse"),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """``make(table, row, …)``: a table of the data model from partial rows."""

    def build(table: str, *rows: dict):
        schema = spark.createDataFrame([], SCHEMAS[table]).schema
        names = [f.name for f in schema.fields]
        for field in schema.fields:
            field.nullable = True
        data = []
        for row in rows:
            full = {**DEFAULTS[table], **row}
            data.append(tuple(full.get(n) for n in names))
        return spark.createDataFrame(data, schema)

    return build
