"""Run registered queries beside their SQL and compare rows, order aside.

    python tests/compare.py [-sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 4) + 0.0)
    if isinstance(v, int):
        return "i" + repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def check(con, df, sql):
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns differ: spark {sorted(df.columns)} sql {sorted(cols)}", len(got)
    if got != want:
        a, b = set(got), set(want)
        only_a, only_b = sorted(a - b)[:3], sorted(b - a)[:3]
        return f"rows {len(got)} vs {len(want)}, differing {len(a - b)}/{len(b - a)}\n   {sorted(cols)}\n   spark {only_a}\n   sql   {only_b}", len(got)
    return None, len(got)


def main(args):
    sf = "0.01"
    if "-sf" in args:
        i = args.index("-sf")
        sf = args[i + 1]
        del args[i : i + 2]
    folder = f"/root/testdata/sf{sf}"
    import __spark_entry__ as entry
    from traymetrics.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args and not any(name == a or name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            if name in oracle:
                err, n = check(con, df, oracle[name])
            else:
                err, n = None, df.count()
        except Exception as e:  # noqa: BLE001
            err, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        if err:
            bad += 1
        print(f"{'FAIL' if err else 'ok  '} {name:40s} rows={n:<8d} {time.time() - t:6.2f}s {'' if name in oracle else '(no sql) '}{err or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
