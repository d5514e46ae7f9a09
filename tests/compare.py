"""Run registered queries and their SQL side by side and compare every value."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return v.item() if hasattr(v, "item") else v


def rows_of(columns, records) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_cell(r[i]) for i in order) for r in records]
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def difference(got, want) -> str | None:
    """None if the results are equal, else what differs."""
    gc, gr = got
    wc, wr = want
    if sorted(gc) != sorted(wc):
        return f"columns {sorted(set(gc) ^ set(wc))}"
    a, b = rows_of(gc, gr), rows_of(wc, wr)
    if len(a) != len(b):
        return f"{len(a)} rows, expected {len(b)}"
    for x, y in zip(a, b):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            bad = [(n, p, q) for n, p, q in zip(sorted(gc), x, y) if p != q or type(p) is not type(q)]
            return f"row differs: {bad}"
    return None


def spark_rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


def duck_rows(con, sql):
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls = e.oracle_sql()
    bad = 0
    for name, q in e.queries().items():
        if only and not any(o in name for o in only):
            continue
        t = time.time()
        try:
            got = spark_rows(q(spark, sf))
            t1 = time.time() - t
            err = difference(got, duck_rows(con, sqls[name])) if name in sqls else "(no sql)"
        except Exception as x:  # report and go on to the next query
            t1, err = time.time() - t, f"{type(x).__name__}: {str(x)[:600]}"
        bad += err is not None and err != "(no sql)"
        print(f"{name:28s} {t1:6.2f}s rows={len(got[1])} {err or 'ok'}", flush=True)
    print("failed:", bad)
