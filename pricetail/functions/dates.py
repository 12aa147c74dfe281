"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_of_year_sunday(date: Column) -> Column:
    """Week number 0-53 whose weeks start on Sunday (strftime ``%U``).

    Days before the first Sunday of the year fall in week 0.  Spark has no
    pattern letter for this numbering and its own week functions are ISO.
    """
    return F.floor((F.dayofyear(date) + 7 - F.dayofweek(date)) / 7).cast("int")


def month_of(date: Column) -> Column:
    return F.month(date)
