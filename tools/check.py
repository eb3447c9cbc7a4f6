"""Runs registered queries against their checking SQL: python tools/check.py SF [name ...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from lodecat.session import build_session  # noqa: E402

NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
         "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6)
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(plain(r[i]) for i in order) for r in data), key=repr)


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf}/{n}.parquet'")
    return con


def compare(spark, con, sf, name, fn, sql):
    start = time.time()
    df = fn(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    spent = f"spark {time.time() - start:.1f}s"
    if sql is None:
        return f"rows {len(got[1])} (no SQL) {spent}"
    rel = con.sql(sql)
    odd = [c for c, k in zip(rel.columns, rel.types) if str(k).startswith(("DEC", "HUGE"))]
    if odd:
        raise AssertionError(f"decimal or huge integer in {odd}")
    want = rows(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        raise AssertionError(f"columns {got[0]} != {want[0]}")
    if got[1] != want[1]:
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        raise AssertionError(
            f"{len(got[1])} vs {len(want[1])} rows; spark only {sorted(a - b)[:2]}; "
            f"sql only {sorted(b - a)[:2]}")
    if not got[1]:
        return "EMPTY"
    return f"ok {len(got[1])} {spent}"


def main() -> None:
    import workload
    workload.load_all()
    sf = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name, fn in workload.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, sf, name, fn, workload.ORACLES.get(name))
        except Exception as e:
            bad += 1
            verdict = f"FAIL {type(e).__name__}: {str(e)[:700]}"
            if "-v" in wanted:
                traceback.print_exc()
        print(f"{name:34} {time.time() - start:5.1f}s {verdict}", flush=True)
    print("bad:", bad, "of", len(workload.QUERIES), "with SQL:", len(workload.ORACLES))


if __name__ == "__main__":
    main()
