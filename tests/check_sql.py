"""Compare every query with its SQL: ``python tests/check_sql.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as entry
from capframe.session import get_spark

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str) -> str:
    df = entry.queries()[name](spark, sf_dir)
    spark_rows = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(spark_rows)}"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"DIFFERENT columns {sorted(df.columns)} / {sorted(columns)}"
    kinds = dict(zip(columns, [str(d[1]) for d in result.description]))
    odd = {c: (t, kinds[c]) for c, t in df.dtypes if TYPES.get(t, t) != kinds[c]}
    if odd:
        return f"DIFFERENT types {odd}"
    other = rows_of(columns, result.fetchall())
    if spark_rows == other:
        return f"equal: {len(other)}"
    bad = [(a, b) for a, b in zip(spark_rows, other) if a != b]
    return f"DIFFERENT {len(spark_rows)} / {len(other)} rows, {len(bad)} differ, first {str(bad[:1])[:600]}"


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark = get_spark("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names or entry.queries():
        start = time.time()
        try:
            verdict = compare(spark, con, sf_dir, name)
        except Exception:
            verdict = "FAILED " + traceback.format_exc()[-1500:]
        failed += verdict.startswith(("FAILED", "DIFFERENT"))
        print(f"{name} [{time.time() - start:.1f}s] {verdict}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
