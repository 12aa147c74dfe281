"""Readers for purchase feeds, monthly cell tables and dimension tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet_tree(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """Every Parquet file below ``root``, at any depth, as one relation."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(root)


def read_months(
    spark: SparkSession,
    root: str,
    months: Iterable[int] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """A table partitioned by ``month``; ``months`` prunes whole folders."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    table = reader.parquet(root)
    if months is None:
        return table
    return table.where(F.col("month").isin([int(m) for m in months]))


def read_parquet_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A single Parquet table, such as store points or product attributes."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """A delimited table with a header line and a declared schema."""
    return spark.read.schema(schema).option("header", "true").option("sep", sep).csv(path)
