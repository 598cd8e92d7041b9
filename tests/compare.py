"""Run registered queries in Spark and their SQL in DuckDB and compare the results."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, int):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


TIMES: dict[str, float] = {}


def compare(name, spark, con, sf_dir, fn, sql) -> str | None:
    """None when equal, else what differs."""
    start = time.time()
    df = fn(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    TIMES[name] = time.time() - start
    if sql is None:
        return None if left else "no rows"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    right = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(cols)}"
    if len(left) != len(right):
        extra = [r for r in left if r not in set(right)][:2]
        lack = [r for r in right if r not in set(left)][:2]
        return f"rows {len(left)} / {len(right)}; only spark {extra}; only sql {lack}"
    if not left:
        return "both empty"
    for a, b in zip(left, right):
        if a != b:
            return f"spark {a} / sql {b}"
    return None


def main() -> None:
    sys.path.insert(0, "/root/repo")
    from tests.conftest import make_session

    import __spark_entry__ as entry

    sf_dir = os.environ.get("COMPARE_SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:]
    queries, oracle = entry.queries(), entry.oracle_sql()
    spark = make_session()
    con = duck(sf_dir)
    bad = 0
    for name, fn in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            problem = compare(name, spark, con, sf_dir, fn, oracle.get(name))
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {TIMES.get(name, 0):.1f}s+{time.time() - start - TIMES.get(name, 0):.1f}s{'' if name in oracle else ' (rows only)'} {problem or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
