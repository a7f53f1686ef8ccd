"""Runs a query in Spark and its SQL in DuckDB and compares the rows exactly.

As a script: ``python tests/oracle.py [sf] [name ...]``.
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tabulon.plans.queries.base import TABLES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql) -> str | None:
    """None if equal, else what differs."""
    got_columns, got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 50_000 else ""
        missing = [r for r in want if r not in set(got)][:2] if len(want) < 50_000 else ""
        return f"{len(got)} rows != {len(want)}; only here {extra}; only there {missing}"
    different = [(a, b) for a, b in zip(got, want) if repr(a) != repr(b)]
    if different:
        return f"{len(different)} of {len(got)} rows differ, first {different[:2]}"
    return None


def main() -> None:
    from tabulon.plans.queries import ORACLES, QUERIES
    from tabulon.session import build_session

    args = sys.argv[1:]
    sf = args.pop(0) if args else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = []
    for name in args or QUERIES:
        started = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                verdict = compare(df, con, ORACLES[name])
            else:
                verdict = None if df.columns and len(df.collect()) > 0 else "no rows"
        except Exception as error:
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        tag = "V" if name in ORACLES else "I"
        print(f"{'ok ' if verdict is None else 'BAD'} {tag} {name} {time.time() - started:.2f}s {verdict or ''}", flush=True)
        if verdict:
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
