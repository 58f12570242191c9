"""Run every registered query in Spark and its oracle SQL in DuckDB and
compare row counts, column names and the multiset of row values.

Usage: python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if hasattr(v, "item"):
        return v.item()
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def close(a: Counter, b: Counter, tol=1e-9) -> bool:
    def key(row):
        return tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    ka, kb = Counter(), Counter()
    for r, n in a.items():
        ka[key(r)] += n
    for r, n in b.items():
        kb[key(r)] += n
    return ka == kb


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and os.path.isdir(argv[1]) else "/root/testdata/sf0.01"
    only = [a for a in argv[1:] if not os.path.isdir(a)]
    import __spark_entry__ as e
    from samplequote.session import build_session
    spark = build_session()
    qs, sql = e.queries(), e.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(ex).__name__}: {str(ex)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sql:
            print(f"ROWS {name}: {len(rows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(sql[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(ex)[:600]}")
            bad += 1
            continue
        if sorted(cols) != sorted(dcols):
            print(f"FAIL {name}: columns {sorted(cols)} vs {sorted(dcols)}")
            bad += 1
            continue
        a, b = canon(rows, cols), canon(drows, dcols)
        status = "OK  " if a == b else ("NEAR" if close(a, b) else "FAIL")
        if status != "OK  ":
            bad += status == "FAIL"
            diff_a = list((a - b).items())[:3]
            diff_b = list((b - a).items())[:3]
            print(f"{status} {name}: {len(rows)} vs {len(drows)} rows; spark-only {diff_a}; duck-only {diff_b}")
        else:
            print(f"OK   {name}: {len(rows)} rows {ts:.1f}s")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
