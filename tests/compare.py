"""Run registered queries against their SQL in DuckDB: python tests/compare.py SF [key ...]"""

import math
import os
import sys
import time
from datetime import date, datetime

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat(" ")
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return rows_of(names, cur.fetchall())


def difference(got, want):
    """None if equal, else a short text."""
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    if got[1] == want[1]:
        return None
    a, b = set(got[1]), set(want[1])
    return f"{len(got[1])} / {len(want[1])} rows; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}; differing {len(a - b)}"


def main(sf, keys):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{sf}"
    con = connect(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for key, fn in entry.queries().items():
        if keys and key not in keys:
            continue
        start = time.time()
        try:
            got = spark_rows(fn(spark, folder))
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{key}: SPARK ERROR {str(e)[:600]}", flush=True)
            continue
        took = time.time() - start
        if key not in oracles:
            print(f"{key}: {len(got[1])} rows, no SQL, {took:.1f}s", flush=True)
            continue
        start = time.time()
        try:
            want = duck_rows(con, oracles[key])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{key}: SQL ERROR {str(e)[:400]}", flush=True)
            continue
        diff = difference(got, want)
        bad += diff is not None
        note = "" if len(got[1]) else " EMPTY"
        print(f"{key}: {'ok' if diff is None else 'DIFF ' + diff} {len(got[1])} rows {took:.1f}s sql {time.time() - start:.1f}s{note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], set(sys.argv[2:]))
