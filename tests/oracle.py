"""Compare registered queries with their SQL on one of the given tables' folders: python tests/oracle.py FOLDER [NAME...]."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def rows_of(frame):
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False, name=None))


def difference(spark, con, name, run, sql, folder) -> str:
    got, want = rows_of(run(spark, folder).toPandas()), rows_of(con.sql(sql).df())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows; first {got[1][:1]} and {want[1][:1]}"
    odd = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    return f"{len(odd)} of {len(got[1])} rows differ: {odd[0]}" if odd else ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sys.path.insert(0, str(Path(__file__).parent.parent))
    from tracelake.plans import registry

    folder = sys.argv[1]
    spark = SparkSession.builder.master(f"local[{os.environ.get('CPUS', '4')}]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in sys.argv[2:] or registry.QUERIES:
        try:
            if name in registry.ORACLE_SQL:
                said = difference(spark, con, name, registry.QUERIES[name], registry.ORACLE_SQL[name], folder) or "ok"
            else:
                said = f"no SQL, {registry.QUERIES[name](spark, folder).count()} rows"
        except Exception as e:
            said = f"FAILED {str(e)[:600]}"
        print(f"{name}: {said}", flush=True)
