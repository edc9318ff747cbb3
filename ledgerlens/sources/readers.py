"""Reading raw transaction parts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Raw columns as text: bad dates and numbers reach the lenient casts instead of
# failing the read.
RAW_TEXT_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country")
    ]
)

RAW_SCHEMA = T.StructType(
    [
        T.StructField("Invoice", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.DoubleType()),
        T.StructField("InvoiceDate", T.TimestampNTZType()),
        T.StructField("Price", T.DoubleType()),
        T.StructField("Customer ID", T.DoubleType()),
        T.StructField("Country", T.StringType()),
    ]
)


def load_parts(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Stack parts by column name; a column missing from one part is null there.

    Without a `schema` every column is read as text, so a column that holds numbers in one part and text in
    another keeps both. The lenient casts of the cleaning come later.
    """
    if not paths:
        raise ValueError("no input parts given")
    parts = [_read(spark, path, fmt, schema) for path in paths]
    return stack(parts if schema is not None else [as_text(part) for part in parts])


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))


def stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType | None) -> DataFrame:
    reader = spark.read
    if fmt == "csv":
        # Every part brings its own header, so names decide and not positions.
        reader = reader.option("header", True).option("enforceSchema", False)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


def save_raw(df: DataFrame, path: str) -> None:
    """Keep the stacked raw table in a columnar form that later runs read directly."""
    df.write.mode("overwrite").parquet(path)


def load_raw(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def overview(df: DataFrame) -> DataFrame:
    """Column names and types with the row count of the table."""
    entries = F.array(
        *(
            F.struct(F.lit(i).alias("Position"), F.lit(f.name).alias("Column"), F.lit(f.dataType.simpleString()).alias("Dtype"))
            for i, f in enumerate(df.schema)
        )
    )
    counted = df.agg(F.count(F.lit(1)).alias("Rows"))
    return counted.select("Rows", F.lit(len(df.columns)).alias("Columns"), F.explode(entries).alias("_e")).select(
        "Rows", "Columns", "_e.Position", "_e.Column", "_e.Dtype"
    )


def first_rows(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
