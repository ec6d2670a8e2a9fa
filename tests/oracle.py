"""Run queries next to their oracle SQL:  python tests/oracle.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, float):
        return "fnan" if math.isnan(v) else f"f{v!r}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{plain(k)}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    return f"{type(v).__name__[0]}{v}"


def compare(df, con, sql):
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", 0
    rows = cur.fetchall()
    pick = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in pick) for r in rows)
    if got == want:
        return None, len(got)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)}/{len(got)} rows differ in {cols}: {bad[0][0]} vs {bad[0][1]}", len(got)


def main():
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                error, n = compare(df, con, oracle[name])
            else:
                n = len(df.collect())
                error = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            error, n = f"{type(e).__name__}: {str(e)[:1500]}", 0
        mark = "ok " if error is None else "BAD"
        print(f"{mark} {name:40s} {n:7d} rows {time.time() - t0:6.2f}s {'' if name in oracle else 'rows-only'} {error or ''}", flush=True)
        if error:
            failed.append(name)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main()
