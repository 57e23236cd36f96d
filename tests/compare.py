"""Run the registered queries against their SQL and compare whole results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings"
          " pages benchmark labels conversations").split()


TIMES = [0.0, 0.0]


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, float)):
        return repr(float(value))
    return repr(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(row[i]) for i in order) for row in data)


def compare(spark, con, sf_dir, query, sql):
    """None if both sides agree, else a short description of the difference."""
    start = time.time()
    df = query(spark, sf_dir)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    mid = time.time()
    res = con.execute(sql)
    columns = [c[0] for c in res.description]
    theirs = rows(columns, res.fetchall())
    TIMES[:] = [mid - start, time.time() - mid]
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if ours == theirs:
        return None
    ours_set, theirs_set = set(ours), set(theirs)
    return (f"{len(ours)} rows vs {len(theirs)}; only spark {sorted(ours_set - theirs_set)[:2]};"
            f" only sql {sorted(theirs_set - ours_set)[:2]}")


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.shuffle.partitions", "8").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    con, sqls = duck(sf_dir), entry.oracle_sql()
    for name in names:
        try:
            result = compare(spark, con, sf_dir, entry.queries()[name], sqls[name])
        except Exception as error:
            result = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:24s} spark {TIMES[0]:6.2f}s sql {TIMES[1]:6.2f}s {'ok' if result is None else result[:900]}", flush=True)
