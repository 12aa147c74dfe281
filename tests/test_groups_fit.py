"""Regressions by group: each equals the fit of its own rows, and none passes through the driver."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetail.operators import regress as R


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(21)
    n, k = 1200, 4
    g = rng.integers(0, k, n)
    g[: n // 3] = 0  # one group holds much of the data
    a, b, c = rng.integers(0, 12, n), rng.integers(0, 9, n), rng.integers(0, 15, n)
    x, w = rng.normal(0, 1, n), rng.normal(3, 1, n)
    x[g == 2] = 0.0  # a term that one group drops
    y = 1 + (g + 1) * x - 0.5 * w + 0.3 * a + rng.normal(0, 1, n)
    z = w + rng.normal(0, 1, n)
    data = [(f"g{i}", *map(int, p), *map(float, q)) for i, *p, q in zip(g, a, b, c, zip(x, w, z, y))]
    df = spark.createDataFrame(data, "g string, a int, b int, c int, x double, w double, z double, y double")
    return df.persist()


def tidy(fit, key=None):
    table = fit.tidy() if key is None else fit.tidy().where(F.col("g") == key).drop("g")
    return {r.term: r for r in table.collect()}


def same(one, other):
    assert one.keys() == other.keys()
    for term, r in one.items():
        for f in ("estimate", "std_error", "t", "p", "ci_low", "ci_high", "n_obs"):
            mine, theirs = r[f], other[term][f]
            assert (mine is None) == (theirs is None), (term, f)
            assert mine is None or mine == pytest.approx(theirs, rel=1e-6, abs=1e-8), (term, f)


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"absorb": ["a"], "cluster": ["b"], "vcov": "cluster"},
        {"absorb": ["a", "b"], "cluster": ["b", "c"], "vcov": "cluster", "fe_dof": "nested"},
        {"cluster": ["g", "c"], "vcov": "cluster", "cluster_df": "own"},
        {"factors": [R.Factor("c")], "absorb": ["a"]},
    ],
)
def test_each_group_equals_its_own_fit(spark, rows, options):
    fit = R.fe_ols(rows, "y", ["x", "w"], by=["g"], **options)
    for key in ("g0", "g2", "g3"):
        alone = R.fe_ols(rows.where(F.col("g") == key), "y", ["x", "w"], **options)
        same(tidy(fit, key), tidy(alone))
        assert fit.coefficients((key,)) == pytest.approx(alone.coefficients(), rel=1e-6)
    assert tidy(fit, "g2")["x"].estimate is None
    with pytest.raises(KeyError):
        fit.coefficients(("none",))


def test_instruments_and_rows_by_group(spark, rows):
    fit = R.iv_2sls(rows, "y", ["w"], ["z"], ["x"], absorb=["a"], cluster=["b"], by=["g"], vcov="cluster")
    alone = R.iv_2sls(rows.where("g = 'g1'"), "y", ["w"], ["z"], ["x"], absorb=["a"], cluster=["b"], vcov="cluster")
    same(tidy(fit, "g1"), tidy(alone))
    both = [R.with_fitted(df, f, "fitted").where("g = 'g1'").agg(F.sum("fitted"), F.sum(F.col("fitted") * F.col("x"))).first() for df, f in ((rows, fit), (rows.where("g = 'g1'"), alone))]
    assert tuple(both[0]) == pytest.approx(tuple(both[1]), rel=1e-6)


def test_no_rows_and_no_intercept(spark, rows):
    assert R.fe_ols(rows.where("false"), "y", ["x"], by=["g"]).tidy().collect() == []
    shown = R.fe_ols(rows, "y", ["w"], by=["g"]).without_intercept().tidy()
    assert {r.term for r in shown.collect()} == {"w"}


def test_thousands_of_groups(spark):
    """5,000 groups: coefficients match closed forms, and stay a table."""
    n = 5000
    df = spark.range(n * 6).select(
        (F.col("id") % n).alias("g"), (F.floor(F.col("id") / n) % 3).alias("a"), F.rand(1).alias("x"), F.rand(2).alias("u")
    ).withColumn("y", F.col("x") * (F.col("g") % 7) + F.col("u") + F.col("a"))
    df = df.persist()
    fit = R.fe_ols(df, "y", ["x"], absorb=["a"], by=["g"], cluster=["a"], vcov="cluster")
    assert fit.groups == [] and fit.solutions.count() == n
    d = df.withColumns({c: F.col(c) - F.expr(f"avg({c}) OVER (PARTITION BY g, a)") for c in ("x", "y")})
    plain = d.groupBy("g").agg((F.sum(F.expr("x * y")) / F.sum(F.expr("x * x"))).alias("b"))
    off = fit.tidy().join(plain, "g").agg(F.max(F.abs(F.col("estimate") - F.col("b"))), F.count("*")).first()
    assert off[0] < 1e-8 and off[1] == n


def test_nothing_is_collected_by_group():
    for function in (R._solved_groups, R._cluster_scores, R.panel_gram, R.score_gram, R._wide_sums, R._with_coefficients):
        text = inspect.getsource(function)
        assert ".collect()" not in text and "createDataFrame" not in text and "toPandas" not in text
