"""Price-ending shares and the summary tables around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import owner_group_label
from ..session import materialise


def share(flag: str) -> Column:
    return F.avg(F.col(flag).cast("int"))


def ending_share(df: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    """Share of rows with each flag set, per group or overall (``by=[]``)."""
    return df.groupBy(*by).agg(*[share(f).alias(f) for f in flags])


def chain_league(
    df: DataFrame, chain: str, owner: str, flags: list[str], groups: dict[str, str] | None = None
) -> DataFrame:
    """Chains ranked by their share of the first flag, with an owner label.

    The rank runs over one row per chain, so a single sorted partition is fine.
    """
    table = ending_share(df, [chain, owner], flags)
    rank = F.row_number().over(Window.orderBy(flags[0], chain))
    return table.withColumn("row", rank.cast("long")).withColumn(
        "owner_lab", owner_group_label(F.col(owner), groups)
    )


def store_profile(
    df: DataFrame, store: str, flags: list[str], sums: list[str], chain: str | None = None
) -> DataFrame:
    """Per store: flag shares, summed measures and its chain.

    The chain is the smallest value seen, so the pick does not depend on order.
    """
    picked = [F.min(chain).alias(chain)] if chain else []
    known = df.where(F.col(store).isNotNull())
    return known.groupBy(store).agg(
        *[share(f).alias(f) for f in flags], *picked, *[F.sum(c).alias(c) for c in sums]
    )


def mean_by(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def mean_and_std(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return df.groupBy(*by).agg(*aggs)


def _stacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value): the named columns below each other."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """(column, share, value): exact quantiles, interpolated between neighbouring ranks.

    Values are counted, and the counts dealt in ranges of values; sums of whole
    ranges say which ranges hold the wanted ranks, and only those are looked
    into.  No task needs all values of a column.
    """
    counts = _stacked(df, columns).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    dealt = materialise(counts.repartitionByRange("column", "value").withColumn("range", F.spark_partition_id()))
    sums = dealt.groupBy("column", "range").agg(F.sum("n").alias("size"))
    earlier = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("column")
    sums = sums.withColumns({"before": F.coalesce(F.sum("size").over(earlier), F.lit(0)), "total": F.sum("size").over(everything)})
    wanted = sums.withColumn("share", F.explode(F.array(*[F.lit(float(p)) for p in shares])))
    wanted = wanted.withColumn("position", F.col("share") * (F.col("total") - 1))
    wanted = wanted.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("position"), F.ceil("position")))))
    # One range for each column, share and rank.
    wanted = wanted.where("rank >= before AND rank < before + size").select("column", "range", "before", "share", "position", "rank")
    so_far = Window.partitionBy("column", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    places = dealt.join(F.broadcast(wanted.select("column", "range").distinct()), ["column", "range"], "left_semi")
    places = places.withColumn("upto", F.sum("n").over(so_far)).join(F.broadcast(wanted), ["column", "range"])
    found = places.where("rank >= before + upto - n AND rank < before + upto")
    ends = found.groupBy("column", "share", "position").agg(
        F.min(F.struct("rank", "value")).alias("low"), F.max(F.struct("rank", "value")).alias("high")
    )
    low, high, at = F.col("low.value"), F.col("high.value"), F.col("position")
    between = (F.col("high.rank") - at) * low + (at - F.col("low.rank")) * high
    return ends.select("column", "share", F.when(low == high, low).otherwise(between).alias("value"))


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles, one row per column."""
    table = _stacked(df, columns).groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    found = exact_quantiles(df, columns, list(QUARTILES.values()))
    wide = found.groupBy("column").agg(*[F.max(F.when(F.col("share") == p, F.col("value"))).alias(q) for q, p in QUARTILES.items()])
    return table.join(wide, "column", "left").select("column", "count", "mean", "std", "min", *QUARTILES, "max")


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])


def sample_variances(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.var_samp(c).alias(c) for c in columns])


def histogram(df: DataFrame, column: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts in equal-width bins between each group's minimum and maximum.

    Bins are half open but for the last, which holds the maximum.  A group with
    a single value gets a range of one unit around it.  Empty bins are absent.
    """
    by = by or []
    v = F.col(column)
    known = df.where(v.isNotNull())
    # One row per (group, value): the range and the bins follow from these.
    values = known.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    bounds = values.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    if by:
        ranged = values.join(bounds, by)
    else:
        low, high = bounds.select("_lo").scalar(), bounds.select("_hi").scalar()
        ranged = values.withColumns({"_lo": low, "_hi": high})
    flat = F.col("_lo") == F.col("_hi")
    ranged = ranged.withColumns(
        {
            "_lo": F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")),
            "_hi": F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")),
        }
    ).withColumn("width", (F.col("_hi") - F.col("_lo")) / bins)
    index = F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    binned = ranged.withColumn("bin", F.least(index, F.lit(bins - 1)).cast("int"))
    return (
        binned.groupBy(*by, "bin", "_lo", "width")
        .agg(F.sum("_n").alias("n"))
        .select(
            *by,
            "bin",
            (F.col("_lo") + F.col("bin") * F.col("width")).alias("bin_start"),
            "width",
            "n",
        )
    )


def density(df: DataFrame, column: str, bins: int, by: list[str]) -> DataFrame:
    """Histogram scaled so that each group's bars cover an area of one."""
    counts = histogram(df, column, bins, by)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    scaled = F.col("n") / (F.col("_total") * F.col("width"))
    return counts.join(totals, by).withColumn("density", scaled).drop("_total")
