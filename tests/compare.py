"""Runs registered queries beside their DuckDB SQL: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con.sql(sql).df()


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v)).lower()
    if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.ndim == 0 and v.dtype.kind in "iuf":
        return f"{float(v):.9g}" if float(v) != 0 else "0"
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return str([_cell(x) for x in v])
    return str(v)


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df.astype(object).where(df.notna(), None) if len(df) else df
    return sorted(tuple(_cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(sql_df.columns)}"
    a, b = canonical(spark_df), canonical(sql_df)
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"rows {len(a)} vs {len(b)}; only Spark {only_a}; only SQL {only_b}"


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as e

    queries, oracles = e.queries(), e.oracle_sql()
    spark, bad = session(), 0
    for name in names or list(queries):
        began = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - began
            said = difference(got, oracle_rows(sf_dir, oracles[name])) if name in oracles else "no SQL"
        except Exception as x:
            took, got, said = time.time() - began, [], f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(said) and said != "no SQL"
        print(f"{'ok ' if not said else '-- ' if said == 'no SQL' else 'BAD'} {name} {len(got)} rows {took:.1f} s {said}", flush=True)
    return bad


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sys.exit(main(sys.argv[1], sys.argv[2:]))
