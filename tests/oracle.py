"""Runs registered queries against their SQL twins in DuckDB: python -m tests.oracle [sf] [name-prefix ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DATA = os.environ.get("ASSAY_TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = _rows(df.columns, [tuple(x) for x in df.collect()])
    took = time.time() - t0
    if sql is None:
        return True, f"{took:5.1f}s rows={len(got)} (rows only)"
    t0 = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = _rows(cols, cur.fetchall())
    duck = time.time() - t0
    head = f"{took:5.1f}s duck={duck:4.1f}s rows={len(got)}"
    if sorted(df.columns) != sorted(cols):
        return False, f"{head} columns {sorted(df.columns)} != {sorted(cols)}"
    if len(got) != len(want):
        return False, f"{head} oracle rows={len(want)} first={got[:1]} want={want[:1]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{head} {len(bad)} rows differ\n   cols={sorted(cols)}\n   got ={bad[0][0]}\n   want={bad[0][1]}"
    return True, head


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from assay.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    prefixes = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{DATA}/{sf}"
    con = connect(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, note = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:26s} {note}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
