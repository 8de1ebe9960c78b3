"""Run registered queries and compare them with their SQL twins in DuckDB.

Usage: python tests/oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(v):
    """Comparable form of a cell."""
    import datetime
    import decimal

    import numpy as np
    if v is None:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return float(v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        f = float(v)
        return None if math.isnan(f) else (0.0 if f == 0 else f)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return v


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 2e-6 + 1e-9 * abs(a)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    return a == b


def key(row):
    return tuple((x is None, str(type(x)), round(x, 4) if isinstance(x, float) else x) if not isinstance(x, tuple)
                 else (False, "t", str(x)) for x in row)


def compare(df, con, sql) -> str | None:
    """None when both give the same rows, else what differs."""
    names = sorted(df.columns)
    got = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"columns {names} vs {sorted(cols)}"
    at = [cols.index(n) for n in names]
    want = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    got.sort(key=key)
    want.sort(key=key)
    for g, w in zip(got, want):
        if not all(close(a, b) for a, b in zip(g, w)):
            return f"{names}: {g} vs {w}"
    return None


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    import __spark_entry__ as E
    from cloudsieve.session import get_spark
    spark = get_spark("oracle", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(a.sf)
    q, sql = E.queries(), E.oracle_sql()
    bad = 0
    for n in a.names or q:
        t = time.time()
        try:
            if n in sql:
                diff = compare(q[n](spark, a.sf), con, sql[n])
            else:
                rows = q[n](spark, a.sf).count()
                diff = None if rows else "no rows"
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {n} {time.time() - t:.1f}s {'' if n in sql else '(no sql) '}{diff or ''}",
              flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
