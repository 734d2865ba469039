"""Run a registered query on Spark and its SQL on DuckDB; compare results.

Comparison: same row count, same column names, and the same multiset of rows
after rounding floats to 6 places (order-insensitive).
"""
from __future__ import annotations

import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hirestream.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, f"{round(v, 6):.6f}")
    if isinstance(v, bool):
        return (2, str(v))
    if isinstance(v, int):
        return (1, f"{float(v):.6f}")
    if isinstance(v, (list, tuple)):
        return (3, tuple(_norm(x) for x in v))
    if isinstance(v, dict):
        return (4, tuple(sorted((k, _norm(x)) for k, x in v.items())))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return (5, str(v))


def compare(spark, con, name, fn, sql, sf_dir):
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    problems = []
    if sorted(scols) != sorted(dcols):
        problems.append(f"columns differ: spark={scols} duck={dcols}")
        return problems, len(srows), len(drows)
    if len(srows) != len(drows):
        problems.append(f"row count spark={len(srows)} duck={len(drows)}")
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    sset = sorted(tuple(_norm(r[i]) for i in si) for r in srows)
    dset = sorted(tuple(_norm(r[i]) for i in di) for r in drows)
    if sset != dset:
        diff_s = [r for r in sset if r not in set(dset)][:3]
        diff_d = [r for r in dset if r not in set(sset)][:3]
        problems.append(f"values differ ({order}); spark-only={diff_s} duck-only={diff_d}")
    return problems, len(srows), len(drows)


def main(argv):
    from hirestream.session import get_session
    import __spark_entry__ as E
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = argv[1:] or list(E.queries())
    spark = get_session(f"local[{os.environ.get('CPUS', '8')}]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, oracle = E.queries(), E.oracle_sql()
    bad = 0
    for n in names:
        if n not in oracle:
            rows = qs[n](spark, sf_dir).count()
            print(f"{n:28s} rows-only  rows={rows}")
            continue
        try:
            probs, ns, nd = compare(spark, con, n, qs[n], oracle[n], sf_dir)
        except Exception as e:  # noqa: BLE001
            probs, ns, nd = [f"ERROR {type(e).__name__}: {str(e)[:400]}"], -1, -1
        status = "OK" if not probs else "FAIL"
        bad += bool(probs)
        print(f"{n:28s} {status:5s} rows={ns}/{nd} {' | '.join(probs)[:1500]}")
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
