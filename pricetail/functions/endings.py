"""Tests for prices that end in nine.

Four definitions are in use and they are not interchangeable:

``A``  unit digit is 9; fraction, rounded to two digits, is at least 0.9.
``B``  unit digit is 9 and the whole part is below 90; cents are 90, 95 or 99.
``C``  as B, with a missing price counted as False.
``D``  on the printed price: the whole part ends in 9; the decimals end in
       9, 90 or 95 (so 12.19 counts, and 12.90 printed as 12.9 counts too).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import is_finite

KINDS = ("A", "B", "C", "D")

# Fixed values of definition B and patterns of definition D.
NINE_CENTS = [90, 95, 99]
UNIT_BELOW = 90
WHOLE_PATTERN = r"\d*9$"
DECIMALS_PATTERN = r"9$|90$|95$"
# Larger prices print in scientific notation, without an ending.
PRINTED_BELOW = 1e16


def unit_digit(price: Column) -> Column:
    return F.pmod(F.floor(price), F.lit(10))


def cent_fraction(price: Column) -> Column:
    return F.round(price - F.floor(price), 2)


def _finite_or_null(price: Column) -> Column:
    # Casting an infinite price to a whole number is an error under ANSI.
    return F.when(is_finite(price), price)


def _printed(price: Column) -> Column:
    """The shortest decimal text of a price, never in scientific notation."""
    text = price.cast("string")
    wide = F.rtrim(text.cast("decimal(38,18)").cast("string"), F.lit("0"))
    plain = F.abs(price).between(0.001, 9999999.0) | (price == 0)
    in_range = F.abs(price) < PRINTED_BELOW
    return F.when(plain, text).when(in_range, wide)


def _part(price: Column, index: int) -> Column:
    part = F.coalesce(F.get(F.split(_printed(_finite_or_null(price)), r"\."), F.lit(index)), F.lit(""))
    # Beyond the digits a price can print, no ending is known.
    return F.when(is_finite(price) & (F.abs(price) >= PRINTED_BELOW), F.lit(None)).otherwise(part)


def ends_unit_nine(price: Column, kind: str = "B") -> Column:
    if kind == "A":
        return unit_digit(price) == 9
    if kind == "D":
        return _part(price, 0).rlike(WHOLE_PATTERN)
    whole = _finite_or_null(price).cast("long")
    test = (F.pmod(whole, F.lit(10)) == 9) & (whole < UNIT_BELOW)
    return _missing_rule(test, kind)


def ends_cent_nine(price: Column, kind: str = "B") -> Column:
    if kind == "A":
        return cent_fraction(price) >= 0.9
    if kind == "D":
        return _part(price, 1).rlike(DECIMALS_PATTERN)
    # rint rounds halves to even, as the definition requires.
    cents = F.rint(_finite_or_null(price) * 100).cast("long")
    return _missing_rule(F.pmod(cents, F.lit(100)).isin(NINE_CENTS), kind)


def ends_nine(price: Column, kind: str = "B") -> Column:
    return ends_unit_nine(price, kind) | ends_cent_nine(price, kind)


def _missing_rule(test: Column, kind: str) -> Column:
    if kind not in KINDS:
        raise ValueError(f"unknown ending definition {kind!r}, expected one of {KINDS}")
    return F.coalesce(test, F.lit(False)) if kind == "C" else test


def with_endings(df: DataFrame, price: str = "ppu", kind: str = "B") -> DataFrame:
    """Add ``unit_nine``, ``cent_nine`` and ``any_nine`` for a price column."""
    unit, cent = ends_unit_nine(F.col(price), kind), ends_cent_nine(F.col(price), kind)
    return df.withColumns({"unit_nine": unit, "cent_nine": cent, "any_nine": unit | cent})
