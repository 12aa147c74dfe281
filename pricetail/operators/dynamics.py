"""Prices over time: instruments, market minimum, product paths, discounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.endings import ends_unit_nine, with_endings
from ..functions.scalars import is_multiple_of
from ..session import materialise
from .groups import group_mode, group_modes, join_group_table, join_sized_table, with_group_stats


def group_mean_instrument(
    df: DataFrame,
    by: list[str],
    price: str = "ppu",
    leave_out: str | None = None,
    name: str = "price_iv",
) -> DataFrame:
    """Mean price of the row's group, optionally without the row's own unit.

    ``leave_out`` names a column such as the store or the municipality: rows of
    the group that share its value are left out of the mean.  A group with no
    other unit gives NULL.
    """
    if leave_out is None:
        return with_group_stats(df, by, {name: F.avg(price)})
    # Everything is settled on one row per group and unit; rows join once.
    unit = [*by, leave_out]
    own = df.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.coalesce(F.sum(price), F.lit(0.0)).alias("_own_sum"),
        F.count(price).alias("_own_cnt"),
    )
    whole = own.groupBy(*by).agg(F.sum("_own_sum").alias("_sum"), F.sum("_own_cnt").alias("_cnt"))
    others = F.col("_cnt") - F.col("_own_cnt")
    mean = F.when(others > 0, (F.col("_sum") - F.col("_own_sum")) / others)
    table = own.join(whole, by).select(*unit, "_rows", mean.alias(name))
    return join_sized_table(df, table, unit)


def demean(df: DataFrame, columns: list[str], by: list[str], suffix: str = "_demeaned") -> DataFrame:
    """Each column minus its group mean."""
    means = {f"_mean_{c}": F.avg(c) for c in columns}
    joined = with_group_stats(df, by, means)
    out = {f"{c}{suffix}": F.col(c) - F.col(f"_mean_{c}") for c in columns}
    return joined.withColumns(out).drop(*means)


def demean_in_turn(df: DataFrame, columns: list[str], groupings: list[list[str]], suffix: str = "_demeaned") -> DataFrame:
    """Demean by the first grouping, the result by the next, and so on, once each.

    Every round reads its input three times, so the rounds are written out in
    between rather than nested.
    """
    current = df.withColumns({f"{c}{suffix}": F.col(c).cast("double") for c in columns})
    names = [f"{c}{suffix}" for c in columns]
    for i, by in enumerate(groupings):
        current = demean(materialise(current) if i else current, names, by, suffix="__next")
        current = current.drop(*names).withColumnsRenamed({f"{n}__next": n for n in names})
    return current


def market_min_response(
    df: DataFrame, lag_scope: str = "sku_chain", measures: tuple[str, ...] = ("quantity", "trans", "sales")
) -> DataFrame:
    """How a chain's modal price relates to the previous lowest market price.

    One row per chain, product and week.  ``lag_scope="sku_chain"`` takes the
    market minimum of the chain's previous observed week.  ``"sku"`` takes the
    previous row of the product in (chain, week) order, so the first week of a
    chain looks at the last week of the chain before it.

    Both windows run on the aggregated table: a partition has at most one row
    per chain, or one per chain and week.
    """
    known = df.dropna(subset=["kjedeid", "sku_gtin", "week"])
    table = group_mode(known, ["kjedeid", "sku_gtin", "week"], "ppu", list(measures))
    market = Window.partitionBy("sku_gtin", "week")
    table = table.withColumn("min_price_week", F.min("ppu").over(market))
    if lag_scope == "sku_chain":
        order = Window.partitionBy("sku_gtin", "kjedeid").orderBy("week")
    elif lag_scope == "sku":
        order = Window.partitionBy("sku_gtin").orderBy("kjedeid", "week")
    else:
        raise ValueError(f"unknown lag scope {lag_scope!r}")
    lagged = F.col("min_price_week_lag")

    def known_and(test):
        return F.coalesce(test, F.lit(False))

    return table.withColumn("min_price_week_lag", F.lag("min_price_week").over(order)).withColumns(
        {
            "price_at_min_lag": known_and(F.col("ppu") == lagged),
            "price_lower_lag": known_and(F.col("ppu") < lagged),
            "price_higher_lag": known_and(F.col("ppu") > lagged),
            "min_price_lag_ldp": ends_unit_nine(lagged, "C"),
            "min_price_lag_int": known_and(is_multiple_of(lagged, 10)),
            "ppu_ldp": ends_unit_nine(F.col("ppu"), "C"),
        }
    )


def product_dynamics(
    df: DataFrame, sku: int, chains: list[str], columns: list[str] | None = None
) -> DataFrame:
    """A product's path per chain and week: modal value of every column, with ending flags."""
    rows = df.where((F.col("sku_gtin") == sku) & F.col("kjedeid").isin(chains))
    by = ["week", "kjedeid"]
    columns = columns or [c for c in df.columns if c not in by]
    return with_endings(group_modes(rows, by, columns), "ppu", "C")


def discounts(df: DataFrame, by: list[str], price: str = "price", usual: str = "ppu") -> DataFrame:
    """Rows priced below the usual (modal) price of their group."""
    usual_price = group_mode(df, by, usual).withColumnRenamed(usual, "usual_price")
    lower = F.coalesce(F.col(price) < F.col("usual_price"), F.lit(False))
    return join_group_table(df, usual_price, by).withColumn("is_discount", lower)
