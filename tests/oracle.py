"""Run registered queries beside their oracle SQL: python tests/oracle.py [sf] [name or subject ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagetrace.sources.lenses import TABLES  # noqa: E402
from pagetrace.suite.registry import registered  # noqa: E402

ROOT = os.environ.get("PAGETRACE_TESTDATA", "/root/testdata")


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 9)
    if hasattr(value, "as_tuple"):
        return round(float(value), 9)
    return value


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def compare(spark, con, folder, fn, sql):
    """(message or None, rows)"""
    df = fn(spark, folder)
    got = _table(df.columns, df.collect())
    if sql is None:
        return (None if got[1] else "no rows"), len(got[1])
    result = con.execute(sql)
    want = _table([c[0] for c in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1])
    if got[1] != want[1]:
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        return f"{len(got[1])} vs {len(want[1])} rows; only spark {sorted(a - b)[:2]}; only oracle {sorted(b - a)[:2]}", len(got[1])
    return (None if got[1] else "both empty"), len(got[1])


def main():
    from pagetrace.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"{ROOT}/sf{sf}"
    spark, con = local_session("8"), connect(folder)
    bad = 0
    for name, (fn, sql) in registered().items():
        if wanted and name not in wanted and fn.__module__.rsplit(".", 1)[-1] not in wanted:
            continue
        start = time.time()
        try:
            message, rows = compare(spark, con, folder, fn, sql)
        except Exception as error:  # report and go on with the next query
            message, rows = f"{type(error).__name__}: {str(error)[:1200]}", -1
        bad += message is not None
        state = "ok" if message is None else "BAD"
        print(f"{state:4}{name:40}{rows:8}{time.time() - start:7.1f}s {'' if sql else '(rows only) '}{message or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
