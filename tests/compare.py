"""Compare queries with their SQL twins over one data folder.

``python tests/compare.py [folder] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def normal(value):
    if isinstance(value, Decimal):
        return f"decimal {value}"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, bool):
        return f"bool {value}"
    if isinstance(value, datetime):
        return f"datetime {value}"
    if isinstance(value, date):
        return f"date {value}"
    return repr(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, connection, folder: str, name: str, queries, oracle) -> str:
    """Empty when the two agree, else the first differences."""
    df = queries[name](spark, folder)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(oracle[name])
    columns = [c[0] for c in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns differ: {sorted(df.columns)} / {sorted(columns)}"
    if ours == theirs:
        return ""
    only_ours = [r for r in ours if r not in set(theirs)][:2]
    only_theirs = [r for r in theirs if r not in set(ours)][:2]
    return f"rows {len(ours)} / {len(theirs)}\n   ours   {only_ours}\n   theirs {only_theirs}"


def main() -> int:
    from rosterlake.session import build_session

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "compare",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    connection = duck(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        if name not in oracle:
            print(f"{name}: no SQL")
            continue
        started = time.time()
        try:
            outcome = compare(spark, connection, folder, name, queries, oracle)
        except Exception as error:  # noqa: BLE001
            outcome = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(outcome)
        print(f"{name}: {outcome or 'ok'} ({time.time() - started:.1f} s)", flush=True)
    print(f"{failed} differ")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 1))
