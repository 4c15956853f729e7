"""Run each registered query in Spark and its oracle SQL in DuckDB; compare like the driver.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SPARK2DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
              "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    return repr(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    from taxonspark.session import get_session, use_checkpoint_dir
    import tempfile
    spark = get_session(master="local[8]", conf={"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    use_checkpoint_dir(spark, tempfile.mkdtemp(prefix="ckpt-", dir="/tmp"))
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ok = bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{name:24s} SPARK ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sql:
            print(f"{name:24s} rows={len(srows)} (no oracle) {ts:.1f}s")
            continue
        try:
            rel = con.sql(sql[name])
            dcols = rel.columns
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:24s} SQL ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        smap = {f.name: SPARK2DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
        dmap = dict(zip(dcols, [str(t) for t in rel.types]))
        tdiff = {c: (smap.get(c), dmap.get(c)) for c in set(smap) | set(dmap) if smap.get(c) != dmap.get(c)}
        if tdiff:
            print(f"   types differ: {tdiff}")
        hs, ls = digest(scols, srows)
        hd, ld = digest(dcols, drows)
        same = sorted(scols) == sorted(dcols) and hs == hd
        status = "OK " if same else "MISMATCH"
        ok += same
        bad += not same
        print(f"{name:24s} {status} rows spark={len(srows)} sql={len(drows)} {ts:.1f}s")
        if not same:
            if sorted(scols) != sorted(dcols):
                print("   cols", sorted(scols), sorted(dcols))
            a, b = set(ls), set(ld)
            for x in list(a - b)[:3]:
                print("   spark-only", x[:300])
            for x in list(b - a)[:3]:
                print("   sql-only  ", x[:300])
    print(f"ok={ok} bad={bad}")


if __name__ == "__main__":
    main()
