"""Run registered queries beside their SQL in DuckDB and compare the results.

    python tools/check.py [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def key(v):
        return (v is None, str(type(v).__name__), v if v is not None else 0)

    return sorted([names[i] for i in order]), sorted(
        (tuple(r[i] for i in order) for r in rows), key=lambda r: [key(v) for v in r]
    )


def compare(name, spark, con, sf_dir, queries, oracles) -> tuple[str, float]:
    start = time.time()
    df = queries[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in oracles:
        return f"rows-only ({len(got)} rows)", took
    cur = con.execute(oracles[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a[0] != b[0]:
        return f"MISMATCH columns {a[0]} vs {b[0]}", took
    if len(a[1]) != len(b[1]):
        return f"MISMATCH rows {len(a[1])} vs {len(b[1])}\n  spark {a[1][:3]}\n  sql   {b[1][:3]}", took
    diff = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    if diff:
        return f"MISMATCH {len(diff)} of {len(want)} values {a[0]}\n  spark {diff[0][0]}\n  sql   {diff[0][1]}", took
    return f"ok ({len(want)} rows)", took


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from tristage.plans.catalog import ORACLES, QUERIES
    from tristage.session import local_session

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(), duck(sf_dir)
    bad = 0
    for name in QUERIES:
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            result, took = compare(name, spark, con, sf_dir, QUERIES, ORACLES)
        except Exception as e:  # report and go on with the other queries
            result, took = f"ERROR {type(e).__name__}: {str(e)[:1500]}", 0.0
        bad += not result.startswith(("ok", "rows-only"))
        print(f"{name:34s} {took:6.2f}s {result}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
