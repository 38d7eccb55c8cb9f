"""Run registered queries in Spark and DuckDB side by side: python tests/compare.py [-s sf] [name part ...]"""

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
KINDS = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    return "" if v is None else str(v)


def compare(spark, con, folder, run, sql):
    """(problems, rows, share of fired columns)"""
    df = run(spark, folder)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*names).collect()]
    problems = []
    if sql is None:
        return problems, got, names
    rel = con.sql(sql)
    types = dict(zip(rel.columns, [str(x) for x in rel.types]))
    if sorted(rel.columns) != names:
        return [f"columns {sorted(rel.columns)} != {names}"], got, names
    spark_types = dict(df.dtypes)
    for n in names:
        if KINDS.get(types[n]) != spark_types[n]:
            problems.append(f"type of {n}: {types[n]} vs {spark_types[n]}")
    order = [rel.columns.index(n) for n in names]
    want = [tuple(r[i] for i in order) for r in rel.fetchall()]
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    a, b = {}, {}
    for rows, d in ((got, a), (want, b)):
        for r in rows:
            k = tuple(normal(v) for v in r)
            d[k] = d.get(k, 0) + 1
    only_a = [k for k in a if a[k] != b.get(k, 0)]
    only_b = [k for k in b if b[k] != a.get(k, 0)]
    if only_a or only_b:
        problems.append(f"values differ: {len(only_a)} / {len(only_b)}\n   spark {sorted(only_a)[:2]}\n   duck  {sorted(only_b)[:2]}")
    return problems, got, names


def main(args):
    from __spark_entry__ import oracle_sql, queries
    from mailgrain.session import build_session
    sf = "0.01"
    if args[:1] == ["-s"]:
        sf, args = args[1], args[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    oracles = oracle_sql()
    bad = 0
    for name, run in queries().items():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            problems, got, names = compare(spark, con, folder, run, oracles.get(name))
        except Exception as e:
            problems, got, names = ["error " + str(e)[:600]], [], []
        flat = [n for i, n in enumerate(names) if len({normal(r[i]) for r in got}) < 2] if len(got) > 1 else []
        mark = "ok  " if not problems and got else "BAD "
        bad += mark == "BAD "
        print(f"RESULT {mark}{name:40s} {time.time() - start:6.1f}s rows={len(got)} {'sql' if name in oracles else 'rows-only'}"
              + (f" constant={flat}" if flat else "") + "".join("\n   " + p for p in problems), flush=True)
    print(f"RESULT {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
