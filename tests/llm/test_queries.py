"""Queries against their SQL, and what is registered."""

from __future__ import annotations

import re
import subprocess
import sys

import pytest
from compare import compare, duck
from conftest import DATA, ROOT

from rosterlake.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def connection():
    return duck(DATA)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_sql(spark, connection, name):
    assert compare(spark, connection, DATA, name, QUERIES, ORACLE) == ""


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))


def test_the_rest_works_without_these_operators():
    code = (
        "import sys; sys.modules['rosterlake.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; names = e.queries()\n"
        "assert len(names) > 70 and not any(n.startswith('op') or n == 'pipeline' for n in names)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
