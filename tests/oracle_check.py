"""Run queries() against oracle_sql() locally (DuckDB in-process).

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.sql(sql)
    dcols, drows = res.columns, res.fetchall()
    scols, s = canon(sdf.columns, srows)
    dcols2, d = canon(dcols, drows)
    ok = scols == dcols2 and s == d
    msg = f"{name:32s} spark={len(srows):6d} duck={len(drows):6d} {'OK' if ok else 'MISMATCH'} {t1-t0:.1f}s"
    if not ok:
        if scols != dcols2:
            msg += f"\n   cols spark={scols}\n   cols duck ={dcols2}"
        else:
            for a, b in zip(s, d):
                if a != b:
                    msg += f"\n   first diff spark={a}\n              duck ={b}"
                    break
    return ok, msg


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    import __spark_entry__ as E
    from raretab.session import local_session
    spark = local_session()
    con = duck(sf_dir)
    qs, ors = E.queries(), E.oracle_sql()
    names = args or list(qs)
    bad = 0
    for n in names:
        if n not in ors:
            t0 = time.time()
            c = qs[n](spark, sf_dir).count()
            print(f"{n:32s} spark={c:6d} (no oracle) {time.time()-t0:.1f}s")
            continue
        try:
            ok, msg = compare(spark, con, n, qs[n], ors[n], sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{n:32s} ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(msg, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
