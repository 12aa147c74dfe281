"""Weekly product-by-store cells, modal prices and their join.

``month`` is part of every key: a week that straddles two months yields two
cells and two sets of modal prices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_finite

CELL_KEY = ["month", "week", "sku_gtin", "store_id"]


def build_cells(lines: DataFrame) -> DataFrame:
    """Transactions, mean unit price and quantity per cell and chain."""
    return lines.groupBy(*CELL_KEY, "kjedeid").agg(
        F.count(F.lit(1)).alias("trans"),
        F.avg("ppu").alias("price"),
        F.sum("quantity").alias("quantity"),
    )


def mean_cents(lines: DataFrame, by: list[str], price: str = "ppu") -> DataFrame:
    """Mean price of each group in whole cents, halves up.

    Prices are summed as integers, so neither the order of the lines nor the
    number of tasks decides which side of a tie a mean falls on.  A price that is
    missing or not finite is left out; a group without any has NULL.
    """
    cents = F.when(is_finite(F.col(price)), F.round(F.col(price) * 100).cast("long"))
    summed = lines.groupBy(*by).agg(F.sum(cents).alias("_cents"), F.count(cents).alias("_n"))
    # div cuts towards zero; the remainder is taken off first, so that it rounds down.
    doubled, twice = "(2 * _cents + _n)", "(2 * _n)"
    mean = F.expr(f"CASE WHEN _n > 0 THEN ({doubled} - pmod({doubled}, {twice})) div {twice} END")
    return summed.withColumn("mean_cents", mean).drop("_cents", "_n")


def price_points(lines: DataFrame, by: list[str], price: str = "ppu") -> DataFrame:
    """How many lines were sold at each price within a group."""
    return lines.groupBy(*by, price).agg(F.count(F.lit(1)).alias("n"))


def build_modes(lines: DataFrame, by: list[str] | None = None, price: str = "ppu") -> DataFrame:
    """Every price that is sold most often in its cell; ties all stay.

    The window sees one row per distinct price of a cell, not the lines.
    """
    key = by or CELL_KEY
    counted = price_points(lines, key, price)
    top = F.max("n").over(Window.partitionBy(*key))
    return counted.withColumn("mode", top).where(F.col("n") == F.col("mode"))


def join_modes(cells: DataFrame, modes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Cells with their modal price; a cell with tied modes appears once per mode.

    Both sides are keyed by the full cell, so no key is hot and the join is a
    plain shuffle join that reuses the partitioning of the aggregates.
    """
    key = key or CELL_KEY
    return cells.join(modes.select(*key, "ppu"), key, "left")
