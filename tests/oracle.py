"""Run registered queries in Spark and their SQL in DuckDB; compare.

Comparison: sorted column names, row count, and the multiset of rows
with values normalised (decimals exact, doubles to 9 places, timestamps
as ISO text).  ``python tests/oracle.py [sf_dir] [name ...]`` prints one
line per query.
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return "b" + str(v)
    if isinstance(v, decimal.Decimal):
        return "n" + format(v.normalize(), "f") if v != 0 else "n0"
    if isinstance(v, float):
        if v != v:
            return "nan"
        r = round(v, 9)
        return "n" + (format(decimal.Decimal(repr(r)).normalize(), "f") if r != 0 else "0")
    if isinstance(v, int):
        return "n" + str(v)
    if isinstance(v, dt.datetime):
        return "t" + v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return "d" + v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return "s" + str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), sorted(cols)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def type_diffs(spark_dtypes, duck_description):
    """Columns whose Spark and DuckDB types differ."""
    d = {x[0]: str(x[1]).replace(" ", "") for x in duck_description}
    out = []
    for c, t in spark_dtypes:
        want = t.upper().replace(" ", "") if t.startswith("decimal") else SPARK_TO_DUCK.get(t, t.upper())
        if d.get(c) != want:
            out.append((c, t, d.get(c)))
    return out


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, sf_dir: str, name: str, build, sql: str, con=None):
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = build(spark, sf_dir)
    s_rows = sdf.collect()
    t1 = time.time()
    res = con.execute(sql)
    types = type_diffs(sdf.dtypes, res.description)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    s_vals, s_cols = rows_of(sdf.columns, [tuple(r) for r in s_rows])
    d_vals, d_cols = rows_of(d_cols, d_rows)
    ok_cols = s_cols == d_cols
    ok_n = len(s_vals) == len(d_vals)
    ok_v = s_vals == d_vals
    detail = ""
    if types:
        detail = f"types {types}"
    elif not ok_cols:
        detail = f"cols spark={s_cols} duck={d_cols}"
    elif not ok_v:
        s_set, d_set = set(s_vals), set(d_vals)
        only_s = sorted(s_set - d_set)[:3]
        only_d = sorted(d_set - s_set)[:3]
        detail = f"spark-only={only_s} duck-only={only_d}"
    return {"name": name, "ok": ok_cols and ok_n and ok_v and not types, "rows": len(s_vals),
            "duck_rows": len(d_vals), "sec": round(t1 - t0, 2), "detail": detail}


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from cardflow.session import build_session
    import __spark_entry__ as E
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        if name not in sqls:
            n = qs[name](spark, sf_dir).count()
            print(f"ROWS {name}: {n} rows (no oracle)", flush=True)
            continue
        try:
            r = compare(spark, sf_dir, name, qs[name], sqls[name], con)
        except Exception as e:  # report and go on
            bad += 1
            print(f"ERR  {name}: {type(e).__name__}: {str(e)[:600]}", flush=True)
            continue
        bad += 0 if r["ok"] else 1
        print(f"{'OK  ' if r['ok'] else 'FAIL'} {name}: {r['rows']} vs {r['duck_rows']} rows "
              f"{r['sec']}s {r['detail']}", flush=True)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
