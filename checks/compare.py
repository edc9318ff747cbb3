"""Run each registered query and its SQL side by side: python -m checks.compare [folder] [key ...]"""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    """Columns and rows in a fixed order, values as text."""
    out = pd.DataFrame({c: [None if pd.isna(v) else _text(v) for v in df[c]] for c in sorted(df.columns)})
    return out.sort_values(list(out.columns), na_position="first").reset_index(drop=True)


def _text(value) -> str:
    if isinstance(value, float):
        return repr(value + 0.0)
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    return str(value)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} vs {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows vs {len(sql_rows)}"
    kinds = {c: (str(spark_rows[c].dtype), str(sql_rows[c].dtype)) for c in spark_rows.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and "datetime" not in k[0] and len(spark_rows)}
    a, b = canonical(spark_rows), canonical(sql_rows)
    if not a.equals(b):
        bad = [c for c in a.columns if not a[c].equals(b[c])]
        rows = (a[bad] != b[bad]).any(axis=1)
        return f"values differ in {bad}:\n{a[rows].head(4)}\n{b[rows].head(4)}\n{odd}"
    return f"types {odd}" if odd else None


def main(folder: str, keys: list[str]) -> int:
    # A plain session: the queries must not depend on this repository's defaults.
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("compare")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    failed = 0
    for key in keys or QUERIES:
        start = time.time()
        try:
            got = QUERIES[key](spark, folder).toPandas()
            took = time.time() - start
            if key not in ORACLE:
                verdict = None if len(got) else "no rows"
                note = "rows only"
            else:
                verdict = difference(got, con.execute(ORACLE[key]).df())
                note = "sql"
        except Exception:
            took, note = time.time() - start, "error"
            verdict = traceback.format_exc()[-1500:]
        failed += verdict is not None
        print(f"{'ok  ' if verdict is None else 'FAIL'} {key} [{note}] {took:.1f}s", flush=True)
        if verdict:
            print(verdict, flush=True)
    missing = set(ORACLE) - set(QUERIES)
    print(f"{failed} failed; sql without query: {sorted(missing)}; without sql: {sorted(set(QUERIES) - set(ORACLE))}")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]) > 0)
