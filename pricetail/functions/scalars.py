"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INF = float("inf")


def unit_price(sales: Column, quantity: Column) -> Column:
    """Sales per unit; a zero quantity gives an infinite price, not an error."""
    infinite = F.when(sales > 0, F.lit(INF)).when(sales < 0, F.lit(-INF)).otherwise(F.lit(float("nan")))
    return F.when(quantity == 0, F.when(sales.isNotNull(), infinite)).otherwise(sales / quantity)


def is_finite(value: Column) -> Column:
    """True for a number that is neither missing, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != INF)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text.cast("string"), "[^0-9]", "")


def to_long_or_null(text: Column) -> Column:
    """Whole number held in a text; NULL when the text is not a number."""
    return text.cast("string").try_cast("double").try_cast("long")


def digit_count_in(code: Column, lengths: list[int]) -> Column:
    return F.length(code.cast("long").cast("string")).isin(lengths)


def decade(value: Column, width: int = 10) -> Column:
    return F.floor(value / width) * width


def is_multiple_of(value: Column, base: int) -> Column:
    return F.pmod(value, F.lit(float(base))) == 0


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


# Two-sided normal critical values at 1, 5 and 10 per cent.
STAR_LEVELS = [(2.576, "***"), (1.96, "**"), (1.645, "*")]


def stars(estimate: Column, std_error: Column) -> Column:
    # An undefined ratio (zero or missing error) earns no star.
    t = F.abs(F.try_divide(estimate, std_error))
    mark = F.lit("")
    for level, text in reversed(STAR_LEVELS):
        mark = F.when(t >= level, F.lit(text)).otherwise(mark)
    return mark


def format_estimate(estimate: Column, std_error: Column) -> Column:
    """Table entry: the estimate with stars above its error in parentheses."""
    return F.concat(
        F.format_string("%.3f", estimate),
        stars(estimate, std_error),
        F.format_string("\n(%.3f)", std_error),
    )


def price_grid(spark: SparkSession, stop: float = 100.0, points: int = 10_000) -> DataFrame:
    """Evenly spaced prices over ``(0, stop]``; price 0 has no logarithm."""
    step = stop / (points - 1)
    return spark.range(1, points).select((F.col("id") * F.lit(step)).alias("price"))
