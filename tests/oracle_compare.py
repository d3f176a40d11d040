"""Side-by-side check of ``queries()`` against ``oracle_sql()`` with DuckDB.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Prints one line per query: rows, column names, order-insensitive values.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if v is None:
        return None
    return str(v)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda t: tuple("" if x is None else str(x) for x in t))


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    if sql is None:
        return f"{name:32s} rows={len(srows):7d} (no oracle) spark={t1 - t0:.1f}s"
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    sc, sv = canon(scols, srows)
    dc, dv = canon(dcols, drows)
    ok_cols = sc == dc
    ok_rows = len(sv) == len(dv)
    ok_vals = sv == dv
    status = "OK " if (ok_cols and ok_rows and ok_vals) else "BAD"
    msg = f"{status} {name:32s} rows={len(srows)}/{len(drows)} cols={'ok' if ok_cols else (sc, dc)} spark={t1 - t0:.1f}s"
    if ok_cols and ok_rows and not ok_vals:
        diffs = [(a, b) for a, b in zip(sv, dv) if a != b][:3]
        msg += f"\n    first diffs: {diffs}"
    return msg


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from flowlens.session import local_session

    spark = local_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            line = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as exc:  # noqa: BLE001
            line = f"ERR {name:32s} {type(exc).__name__}: {str(exc)[:300]}"
        bad += line.startswith(("BAD", "ERR"))
        print(line, flush=True)
    print(f"done: {bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
