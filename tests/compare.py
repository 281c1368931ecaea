"""Run registered queries beside their SQL and compare whole results.

``python tests/compare.py [prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool) or value is None or isinstance(value, (str, int, float)):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(picked, key=repr)


def close(a, b) -> bool:
    return a == b and type(a) is type(b)


def differences(spark, con, query, sql, folder) -> list[str]:
    df = query(spark, folder)
    names, got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    expected_names, expected = table([d[0] for d in cursor.description], cursor.fetchall())
    if names != expected_names:
        return [f"columns {names} != {expected_names}"]
    if len(got) != len(expected):
        return [f"rows {len(got)} != {len(expected)}"]
    bad = [
        (g, e) for g, e in zip(got, expected) if not all(close(x, y) for x, y in zip(g, e))
    ]
    return [f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}"] if bad else []


def main(prefixes) -> int:
    from __spark_entry__ import oracle_sql, queries
    from punctual.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session("8"), connect(folder)
    sql, failed = oracle_sql(), 0
    for name, query in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        begun = time.time()
        try:
            if name in sql:
                problems = differences(spark, con, query, sql[name], folder)
            else:
                rows = query(spark, folder).collect()
                problems = [] if rows else ["no rows"]
                if os.environ.get("SHOW"):
                    print(rows[:8])
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - begun:.2f}s {'' if name in sql else '(rows only) '}{' '.join(problems)}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
