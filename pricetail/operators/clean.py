"""From raw purchase feeds to one cleaned relation of purchase lines."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_of, week_of_year_sunday
from ..functions.endings import cent_fraction, unit_digit
from ..functions.labels import CHAINS
from ..functions.scalars import digit_count_in, is_finite, unit_price
from .groups import small_side

# The study window (open at both ends), the sales cap and the
# description terms that mark bottle deposits and carrier bags.
WINDOW = (dt.date(2018, 5, 31), dt.date(2018, 12, 1))
MAX_SALES = 1000.0
EXCLUDED_TERMS = ["pant", "pose"]
CODE_LENGTHS = [8, 13]

STORE_COLUMNS = ["kjedeid", "paraplykjede"]


@dataclass
class Feed:
    """One supplier of purchase lines and how its stores are recognised.

    ``chains`` keeps only lines of stores in these chains.  A feed with
    ``fixed_chain`` keeps every line and carries that chain name instead.
    """

    lines: DataFrame
    store_key: str = "store_id"
    chains: list[str] | None = None
    fixed_chain: str | None = None
    require_sku: bool = False


def within_window(column: str, window: tuple[dt.date, dt.date]) -> Column:
    """Dates strictly between both ends, in a form the file scan can use."""
    start, end = window
    return (F.col(column) >= F.lit(start + dt.timedelta(days=1))) & (F.col(column) < F.lit(end))


def without_terms(column: str, terms: list[str]) -> Column:
    """No term occurs in the text, whatever its case; a missing text fails."""
    return reduce(lambda a, b: a & b, [~F.col(column).rlike(f"(?i){t}") for t in terms])


def store_lookup(stores: DataFrame) -> DataFrame:
    """Distinct stores with chain, owner and any distances, for joining to lines.

    Broadcast when few, so that lines are not shuffled by store: a busy store
    would otherwise fill one task.
    """
    extra = [c for c in stores.columns if c.startswith("min_distance")]
    key = F.col("id").cast("string").alias("store_id")
    return small_side(stores.select(key, *STORE_COLUMNS, *extra).distinct())


def clean_feed(
    feed: Feed,
    places: DataFrame,
    window: tuple[dt.date, dt.date] = WINDOW,
    max_sales: float = MAX_SALES,
    exclude_terms: list[str] | None = None,
) -> DataFrame:
    """Filter one feed and attach chain and owner from :func:`store_lookup`."""
    terms = EXCLUDED_TERMS if exclude_terms is None else exclude_terms
    keep = (
        (F.col("sales") > 0)
        & (F.col("sales") <= max_sales)
        & within_window("date", window)
        & without_terms("sku_description", terms)
    )
    if feed.require_sku:
        keep = keep & F.col("sku_gtin").isNotNull()
    lines = feed.lines.withColumnRenamed(feed.store_key, "store_id").where(keep)
    lines = lines.select(
        F.to_date("date").alias("date"),
        F.col("store_id").cast("string").alias("store_id"),
        F.col("sku_gtin").cast("long").alias("sku_gtin"),
        F.col("sales").cast("double").alias("sales"),
        F.col("quantity").cast("double").alias("quantity"),
    )
    if feed.fixed_chain is not None:
        joined = lines.join(places, "store_id", "left")
        return joined.withColumn("kjedeid", F.lit(feed.fixed_chain))
    # Keeping listed chains after a left join drops every unmatched line,
    # which makes it an inner join with the listed stores.
    chains = CHAINS if feed.chains is None else feed.chains
    return lines.join(places.where(F.col("kjedeid").isin(chains)), "store_id")


def clean_lines(feeds: list[Feed], stores: DataFrame, **options) -> DataFrame:
    """UNION ALL of the cleaned feeds with week, month and unit price."""
    places = store_lookup(stores)
    parts = [clean_feed(feed, places, **options) for feed in feeds]
    lines = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return lines.withColumns(
        {
            "month": month_of(F.col("date")),
            "week": week_of_year_sunday(F.col("date")),
            "ppu": unit_price(F.col("sales"), F.col("quantity")),
            "kron": unit_digit(F.col("sales")),
            "ore": cent_fraction(F.col("sales")),
        }
    )


def standard_codes(df: DataFrame, column: str = "sku_gtin", lengths: list[int] | None = None) -> DataFrame:
    """Products whose code has a standard number of digits."""
    return df.where(digit_count_in(F.col(column), lengths or CODE_LENGTHS))


def finite_prices(df: DataFrame, price: str = "price", store: str = "store_id") -> DataFrame:
    return df.where(is_finite(F.col(price)) & F.col(store).isNotNull())


def plausible(
    df: DataFrame, price_below: float = 100.0, quantity_below: float = 201.0, capped: str = "price"
) -> DataFrame:
    """Positive price and quantity below the given caps.

    ``capped`` names the column the price cap applies to (mean or modal price).
    """
    return df.where(
        (F.col("price") > 0)
        & (F.col(capped) < price_below)
        & (F.col("quantity") > 0)
        & (F.col("quantity") < quantity_below)
    )


def null_tally(df: DataFrame, column: str) -> DataFrame:
    """Number of rows with and without a value in a column."""
    return df.groupBy(F.col(column).isNull().alias("missing")).agg(F.count(F.lit(1)).alias("n"))
