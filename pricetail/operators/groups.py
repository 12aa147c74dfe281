"""Group-level helpers that stay even when one group holds much of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A group with more than one part in HOT_GROUPS of the rows is hot.  There are
# fewer than HOT_GROUPS of them, which bounds the broadcast of their keys (a few
# hundred kilobytes); their rows are spread over this many salts.
HOT_GROUPS = 10_000
SALTS = 64


# Dimension tables with at most this many rows are broadcast (tens of megabytes
# for a handful of short columns).
BROADCAST_ROWS = 500_000


def small_side(dimension: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Hint a broadcast for a dimension table after counting it.

    The count stops at the limit.  A larger table is returned as it is; Spark
    then shuffles both sides and splits skewed keys.
    """
    limit = BROADCAST_ROWS if max_rows is None else max_rows
    few = dimension.limit(limit + 1).count() <= limit
    return F.broadcast(dimension) if few else dimension


def join_group_table(df: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """Left join of a table with one row per group onto all rows of the groups.

    Rows of large groups are spread over salts, so no task receives a whole
    hot group.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    return join_sized_table(df, table.join(sizes, by), by)


def join_sized_table(df: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """The same for a table that already has the group sizes in ``_rows``."""
    return _split_join(df, table, by, [c for c in table.columns if c not in (*by, "_rows")])


def with_group_stats(df: DataFrame, by: list[str], stats: dict[str, Column]) -> DataFrame:
    """Put group statistics on every row; rows with a missing key get NULL.

    The statistics come from a partially aggregated ``groupBy`` and are joined
    back as in :func:`join_group_table`.  A window would send each group,
    however large, to a single task.
    """
    named = [expr.alias(name) for name, expr in stats.items()]
    table = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *named)
    return _split_join(df, table, by, list(stats))


def _split_join(df: DataFrame, table: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """One left join in which hot groups, and rows with a missing key, are spread by a salt.

    A group is hot if it has more than one row in HOT_GROUPS, so there are fewer
    hot groups than that; their statistics are copied once for each salt.
    """
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in by])
    table = table.where(~missing)
    total = table.agg(F.sum("_rows")).scalar()
    heavy = F.col("_rows") * HOT_GROUPS > total
    hot = table.where(heavy).select(*by, F.lit(True).alias("_hot"))
    spread = 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    salted = df.join(F.broadcast(hot), by, "left").withColumn(
        "_salt", F.when(F.col("_hot") | missing, spread).otherwise(0)
    )
    copies = F.when(heavy, F.sequence(F.lit(1), F.lit(SALTS))).otherwise(F.array(F.lit(0)))
    copied = table.withColumn("_salt", F.explode(copies)).select(*by, "_salt", *values)
    return salted.join(copied, [*by, "_salt"], "left").select(*df.columns, *values)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row per key: the smallest in ``order``, then in all other columns."""
    rest = [c for c in df.columns if c not in keys]
    ordered = order + [c for c in rest if c not in order]
    ordered = [c for c in ordered if c not in keys]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in ordered]).select(*df.columns)


def group_mode(
    df: DataFrame, by: list[str], column: str, sums: list[str] | None = None
) -> DataFrame:
    """Most frequent value per group, the smallest on ties, with optional sums.

    Rows are first reduced to one per (group, value), so a large group is
    spread over tasks and nothing holds all its values at once.
    """
    sums = sums or []
    counts = df.groupBy(*by, column).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in sums]
    )
    best = F.max(
        F.when(F.col(column).isNotNull(), F.struct(F.col("_n"), (-F.col(column)).alias("_v")))
    )
    return (
        counts.groupBy(*by)
        .agg(best.alias("_best"), *[F.sum(c).alias(c) for c in sums])
        .withColumn(column, -F.col("_best._v"))
        .select(*by, column, *sums)
    )


def group_modes(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Most frequent value of each of several columns per group, smallest on ties."""
    types = dict(df.dtypes)
    text = [c for c in columns if types[c] == "string"]
    entries = [
        F.struct(
            F.lit(c).alias("name"),
            (F.lit(None) if c in text else F.col(c)).cast("double").alias("number"),
            (F.col(c) if c in text else F.lit(None)).cast("string").alias("text"),
        )
        for c in columns
    ]
    value = F.struct((-F.col("_n")).alias("rank"), F.col("number"), F.col("text"))
    picked = (
        df.select(*by, F.explode(F.array(*entries)).alias("_e"))
        .select(*by, "_e.*")
        .where(F.col("number").isNotNull() | F.col("text").isNotNull())
        .groupBy(*by, "name", "number", "text")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*by)
        .pivot("name", columns)
        .agg(F.min(value))
    )
    out = [
        F.col(c)["text" if c in text else "number"].cast(types[c]).alias(c) for c in columns
    ]
    return picked.select(*by, *out)
