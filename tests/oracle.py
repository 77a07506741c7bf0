"""Run a query in Spark and its SQL in DuckDB on the same tables, and compare values exactly."""

from __future__ import annotations

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session(cores: str = "8") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("sigweave-tests")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    nullable = [c for c in df.columns if isinstance(df[c].dtype, pd.Int64Dtype) and df[c].isna().any()]
    df = df.astype({c: "float64" for c in nullable})  # as Spark hands over integers with nulls
    return df.sort_values(list(df.columns), kind="stable", na_position="last").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal; floats must agree to 1e-9 after the rounding inside the queries."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        ka, kb = a[c].dtype.kind, b[c].dtype.kind
        if len(a) and ka != kb:
            return f"{c}: type {a[c].dtype} vs {b[c].dtype}"
        if ka == "f":
            bad = ~((a[c] - b[c]).abs() <= 1e-9) & ~(a[c].isna() & b[c].isna())
        else:
            bad = (a[c] != b[c]) & ~(a[c].isna() & b[c].isna())
        if bad.any():
            i = bad.idxmax()
            return f"{c}: {int(bad.sum())} of {len(a)} differ, first\n{a.loc[i].to_dict()}\n{b.loc[i].to_dict()}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    sf_dir = argv[0]
    wanted = argv[1:]
    spark, con = session(), connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not wanted or any(n.startswith(w) for w in wanted)]
    failed = []
    for n in names:
        t = time.time()
        try:
            got = queries[n](spark, sf_dir).toPandas()
            spent = time.time() - t
            if n in sql:
                t = time.time()
                want = con.execute(sql[n]).df()
                d = difference(got, want)
                note = d or "ok"
                if d:
                    failed.append(n)
            else:
                note = "no sql"
            print(f"{n:36s} rows={len(got):6d} spark={spent:5.1f}s sql={time.time() - t:5.1f}s {note}", flush=True)
            if len(got) == 0:
                print("   EMPTY")
        except Exception as e:  # noqa: BLE001
            failed.append(n)
            text = str(e)
            print(f"{n:36s} ERROR {type(e).__name__} {text[:700]}", flush=True)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
