"""Compares registered queries with their check SQL: names, types, row counts and exact values.

Usage: python tests/checker.py [folder] [name or prefix* ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import fnmatch
import os
import sys
import time
from concurrent.futures import ThreadPoolExecutor

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, float):
        return ("nan",) if v != v else ("float", v + 0.0)
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, (dt.date, dt.datetime)):
        return ("time", str(v))
    return ("str", str(v))


def compare(spark, con, folder, fn, sql):
    """Empty string when equal, else what differs."""
    sdf = fn(spark, folder)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(sql)
    dcols = [c[0] for c in cur.description]
    drows = cur.fetchall()
    scols = sdf.columns
    if sorted(scols) != sorted(dcols):
        return f"columns {sorted(set(scols) ^ set(dcols))}"
    order = sorted(scols)
    si, di = [scols.index(c) for c in order], [dcols.index(c) for c in order]
    a = sorted((tuple(_norm(r[i]) for i in si) for r in srows), key=repr)
    b = sorted((tuple(_norm(r[i]) for i in di) for r in drows), key=repr)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        diff = [(c, u, v) for c, u, v in zip(order, x, y) if u != v]
        return f"{len(bad)} of {len(a)} rows differ, e.g. {diff[:4]} in {x}"
    if not a:
        return "EMPTY"
    return ""


def main():
    from aislecast.session import build_session
    from __spark_entry__ import oracle_sql, queries

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:] or ["*"]
    spark, con = build_session("checker"), duck(folder)
    qs, sqls = queries(), oracle_sql()
    only_sql = bool(os.environ.get("CHECK_SQL_ONLY"))
    names = [n for n in qs if any(fnmatch.fnmatch(n, p) for p in pats) and (n in sqls or not only_sql)]

    def check(name):
        t = time.time()
        try:
            if name in sqls:
                msg = compare(spark, con.cursor(), folder, qs[name], sqls[name])
            else:
                msg = "" if qs[name](spark, folder).count() else "EMPTY"
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok ' if not msg else 'BAD'} {time.time() - t:6.2f}s {name}{' (no sql)' if name not in sqls else ''} {msg}", flush=True)
        return bool(msg)

    with ThreadPoolExecutor(int(os.environ.get("CHECK_JOBS", "1"))) as pool:
        bad = sum(pool.map(check, names))
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
