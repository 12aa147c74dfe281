"""Demand by price bin: bin effects, their steps and a line per ten bins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import decade
from .regress import Factor, Fit, fe_ols


def with_price_bin(df: DataFrame, price: str = "ppu", digits: int = 3, name: str = "floor") -> DataFrame:
    """Whole-unit bin of a price rounded half to even."""
    return df.withColumn(name, F.floor(F.bround(F.col(price), digits)).cast("double"))


def fit_bins(
    df: DataFrame,
    y: str,
    bin_column: str,
    absorb,
    reference: float | None = None,
    levels: tuple = (),
    **options,
) -> Fit:
    """Regress on one dummy per price bin with absorbed fixed effects."""
    return fe_ols(df, y, [], [Factor(bin_column, reference, levels)], absorb, **options)


def bin_effects(fit: Fit) -> DataFrame:
    """Bin, estimate and error with the bin as a number, and derived columns.

    ``diff`` is the step from the bin before; ``isnine`` and ``iszero`` mark
    bins that end in nine and in zero.  The window runs over one row per bin.
    """
    [factor] = fit.factors
    [group] = fit.groups
    rows = []
    for i, term in enumerate(group.terms):
        value = float(term[len(factor.column) + 1 : -1])
        variance = float(group.covariance[i, i])
        error = math.sqrt(variance) if variance >= 0 else None
        rows.append((value, float(group.beta[i]), error))
    table = fit.spark.createDataFrame(rows, "bin double, estimate double, std_error double")
    last = F.pmod(F.col("bin"), F.lit(10.0))
    before = F.lag("estimate").over(Window.orderBy("bin"))
    return table.withColumns(
        {
            "group": decade(F.col("bin")).cast("double"),
            "diff": F.col("estimate") - before,
            "isnine": (last == 9).cast("int"),
            "iszero": (last == 0).cast("int"),
        }
    )


def bin_linear_fit(effects: DataFrame, width: int = 10) -> DataFrame:
    """Least-squares line through the bin effects of each range of bins."""
    group = decade(F.col("bin"), width).cast("double").alias("group")
    lines = effects.groupBy(group).agg(
        F.regr_slope("estimate", "bin").alias("slope"),
        F.regr_intercept("estimate", "bin").alias("intercept"),
        F.count(F.lit(1)).alias("bins"),
    )
    return lines.where(F.col("bins") >= 2)
