"""Sinks for the monthly tables and the store table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def write_months(df: DataFrame, root: str) -> None:
    """Write one folder per ``month``.

    The rebalance hint groups rows by month so that a task does not open one
    file per month, and still splits a month that is too large for one task.
    """
    df.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(root)


def replace_months(df: DataFrame, root: str) -> None:
    """Replace the folders of the months that occur in ``df`` and no others.

    The new files of a month are written aside and take the place of the old ones
    when all tasks are done, so a reload can be repeated and survives lost
    executors.  A month without rows in ``df`` keeps what it has.
    """
    writer = df.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("month").parquet(root)


def write_bucketed(df: DataFrame, path: str, key: list[str], buckets: int | None = None) -> DataFrame:
    """Write a table in hash buckets of a key, one sorted file each, and return it.

    Tables with the same key and number of buckets are joined and grouped on the
    key without a shuffle.  The table is known to this session's catalog under a
    name of its own; ``path`` should be in a folder that executors share.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    # The same hash decides on partition and bucket: each task writes one bucket.
    writer = df.repartition(buckets, *key).write.mode("overwrite").format("parquet")
    writer.bucketBy(buckets, *key).sortBy(*key).option("path", path).saveAsTable(name)
    return spark.table(name)


def write_csv_table(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", "true").option("sep", sep).csv(path)
