"""Run registered queries next to their SQL and compare rows, names and values.

usage: python tests/compare.py [sf] [name or prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "NULL"
        return repr(round(f, 9) + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def connect(root: str):
    import duckdb

    from equilake.sources.bridge import SOURCE_TABLES

    con = duckdb.connect()
    for t in SOURCE_TABLES:
        con.execute(f"create view {t} as select * from '{root}/{t}.parquet'")
    return con


def compare(spark, con, root: str, name: str) -> tuple[bool, str]:
    from equilake.queries import ORACLES, QUERIES

    t0 = time.time()
    df = QUERIES[name](spark, root)
    got = df.collect()
    t1 = time.time()
    if name not in ORACLES:
        return True, f"rows only: {len(got)} ({t1 - t0:.1f}s)"
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    gc, gr = rows_of(df.columns, [tuple(r) for r in got])
    wc, wr = rows_of(names, want)
    if gc != wc:
        return False, f"columns {gc} != {wc}"
    if len(gr) != len(wr):
        only = list(dict.fromkeys(set(gr) - set(wr)))[:1], list(dict.fromkeys(set(wr) - set(gr)))[:1]
        return False, f"rows {len(gr)} != {len(wr)} {only}"
    bad = [(a, b) for a, b in zip(gr, wr) if a != b]
    if bad:
        return False, f"{len(bad)}/{len(gr)} differ, columns {gc}, first {bad[0]}"
    return True, f"{len(gr)} rows ({t1 - t0:.1f}s / {t2 - t1:.1f}s)" + (" EMPTY" if not gr else "")


def main() -> None:
    from equilake.queries import QUERIES
    from equilake.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    root = f"/root/testdata/{sf}"
    con = connect(root)
    failed = []
    for name in QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, text = compare(spark, con, root, name)
        except Exception as exc:  # noqa: BLE001 - report and go on
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        print("ok  " if ok else "FAIL", name, text, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
