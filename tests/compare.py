"""Run registered queries next to their SQL and compare values; ``python tests/compare.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return repr(v + 0.0)
        if isinstance(v, list):
            return "[" + ",".join(cell(x) for x in v) + "]"
        return str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def compare(df, con, sql):
    """None when equal, else a short description."""
    got = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    cols, types = list(rel.columns), [str(t) for t in rel.types]
    want = rel.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    mine = dict(df.dtypes)
    bad = {c: (mine[c], t) for c, t in zip(cols, types) if KINDS.get(t, t) != mine[c]}
    if bad:
        return f"types {bad}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = canonical(got, df.columns), canonical(want, cols)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(diff)} of {len(a)} rows differ, first {diff[0]} (columns {sorted(cols)})"
    return None


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        if name.endswith("*"):
            continue
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                problem = compare(df, con, oracle[name])
                label = "OK  " if problem is None else "FAIL"
            else:
                problem, label = f"{len(df.collect())} rows", "ROWS"
        except Exception as e:  # report and go on with the next query
            label, problem = "ERR ", f"{type(e).__name__}: {str(e)[:400]}"
        print(f"{label} {name} {time.time() - t:.1f}s {problem or ''}", flush=True)
