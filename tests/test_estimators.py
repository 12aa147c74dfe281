"""Inputs on which a careless estimator gives a wrong answer."""

import math

import numpy as np
import pandas as pd
import pytest

from pricetail.operators import absorb
from pricetail.operators.groups import with_group_stats
from pricetail.operators.regress import INTERCEPT, Factor, fe_ols, with_fitted
from pyspark.sql import functions as F


def results(fit):
    return {r["term"]: r for r in fit.tidy().collect()}


def sparse_panel(unit):
    """A chain of overlapping levels: plain sweeps converge slowly on it."""
    rng = np.random.default_rng(8)
    a = np.tile(np.repeat(np.arange(4), 2), 3)
    b = np.tile(np.repeat(np.arange(5), 2)[1:-1], 3)
    x = rng.normal(size=len(a)) + a
    y = 2 * x + a - 0.5 * b + 0.1 * rng.normal(size=len(a))
    p = pd.DataFrame({"a": a, "b": b, "x": x * unit, "y": y * unit})
    fixed = np.column_stack([pd.get_dummies(p[c]).astype(float).values for c in "ab"])
    beta = np.linalg.lstsq(np.column_stack([x, fixed]), y, rcond=None)[0][0]
    return p, beta


@pytest.mark.parametrize("unit", [1e-9, 1e9])
def test_convergence_does_not_depend_on_the_unit(spark, unit):
    p, beta = sparse_panel(unit)
    fit = fe_ols(spark.createDataFrame(p), "y", ["x"], (), ["a", "b"])
    assert math.isclose(fit.coefficients()["x"], beta, rel_tol=1e-5)


def test_unconverged_effects_raise(spark):
    p, _ = sparse_panel(1.0)
    with pytest.raises(absorb.NotConverged):
        fe_ols(spark.createDataFrame(p), "y", ["x"], (), ["a", "b"], max_sweeps=4)


def test_regressor_with_a_large_mean(spark):
    rng = np.random.default_rng(1)
    x = 1e6 + rng.normal(size=400)
    p = pd.DataFrame({"x": x, "g": rng.integers(0, 3, 400), "y": 3 * (x - 1e6) + 0.1 * rng.normal(size=400)})
    dense = np.column_stack([x - 1e6, np.ones(400)])
    inverse = np.linalg.inv(dense.T @ dense)
    beta = inverse @ dense.T @ p["y"].values
    e = p["y"].values - dense @ beta
    got = results(fe_ols(spark.createDataFrame(p), "y", ["x"]))
    assert math.isclose(got["x"]["estimate"], beta[0], rel_tol=1e-9)
    assert math.isclose(got[INTERCEPT]["estimate"], beta[1] - 1e6 * beta[0], rel_tol=1e-9)
    assert math.isclose(got["x"]["std_error"], math.sqrt(e @ e / 398 * inverse[0, 0]), rel_tol=1e-6)
    shift = np.array([-1e6, 1.0])
    assert math.isclose(got[INTERCEPT]["std_error"], math.sqrt(e @ e / 398 * (shift @ inverse @ shift)), rel_tol=1e-6)
    # One fit for each group: coefficients are joined by the group.
    df = spark.createDataFrame(p)
    fit = fe_ols(df, "y", ["x"], by=["g"])
    residual = with_fitted(df, fit, residual="res").toPandas()
    assert residual.groupby("g")["res"].mean().abs().max() < 1e-6
    assert residual["res"].abs().max() < 1


def test_undeclared_levels_raise(spark):
    df = spark.createDataFrame([(k, 10.0 * (k == "c") + (k == "b") + 0.01 * i) for i in range(4) for k in "abc"], "k string, y double")
    assert math.isclose(results(fe_ols(df, "y", [], [Factor("k", levels=("a", "b", "c"))]))["k[b]"]["estimate"], 1.0, abs_tol=1e-9)
    with pytest.raises(ValueError):
        fe_ols(df, "y", [], [Factor("k", levels=("a", "b"))])
    with pytest.raises(ValueError):
        fe_ols(df, "y", [], [Factor("k", reference="z")])


def test_two_way_errors_are_never_zero(spark):
    for seed in range(30):
        rng = np.random.default_rng(seed)
        p = pd.DataFrame({"g": np.repeat(range(4), 6), "h": np.tile(range(6), 4), "x": rng.normal(size=24), "w": rng.normal(size=24)})
        p["y"] = p["x"] + rng.normal(size=24)
        d = np.column_stack([p["x"], p["w"], np.ones(24)])
        inverse = np.linalg.inv(d.T @ d)
        e = p["y"].values - d @ (inverse @ d.T @ p["y"].values)
        s = pd.DataFrame(d * e[:, None])
        total = sum(sign * inverse @ (m.T @ m) @ inverse for sign, m in [(1, s.groupby(p["g"]).sum().values), (1, s.groupby(p["h"]).sum().values), (-1, s.values)])
        if np.linalg.eigvalsh(total)[0] < 0 and np.diag(total).min() < 0:
            got = results(fe_ols(spark.createDataFrame(p), "y", ["x", "w"], cluster=["g", "h"], vcov="cluster"))
            assert all(r["std_error"] is None or r["std_error"] > 0 for r in got.values())
            return
    raise AssertionError("no such panel found")


def test_no_rows_give_no_coefficients(spark):
    df = spark.createDataFrame([], "x double, y double, c int")
    assert fe_ols(df, "y", ["x"], cluster=["c"], vcov="cluster").tidy().count() == 0


def test_group_statistics_with_missing_keys(spark):
    rows = [("hot", float(i)) for i in range(300)] + [(None, 1.0)] * 200 + [(f"k{i}", 2.0) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = with_group_stats(df, ["k"], {"m": F.avg("v")}).groupBy("k").agg(F.count("*").alias("n"), F.min("m").alias("m")).collect()
    by = {r["k"]: (r["n"], r["m"]) for r in got}
    assert by["hot"] == (300, 149.5) and by[None] == (200, None) and by["k5"] == (1, 2.0)
