"""Exact quantiles and the description built on them."""

import numpy as np
import pytest

from pricetail.operators.shares import describe, exact_quantiles


def test_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 2, 997), 1)
    x[:400] = 0.5  # one value holds much of the data
    y = [None if k % 3 else float(k) for k in range(997)]
    df = spark.createDataFrame([(float(a), b, None) for a, b in zip(x, y)], "x double, y double, z double")
    shares = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.999, 1.0]
    got = {(r["column"], r["share"]): r["value"] for r in exact_quantiles(df.repartition(5), ["x", "y", "z"], shares).collect()}
    known = np.array([v for v in y if v is not None])
    assert len(got) == 2 * len(shares)
    for p in shares:
        assert got["x", p] == pytest.approx(np.quantile(x, p), abs=1e-12)
        assert got["y", p] == pytest.approx(np.quantile(known, p), abs=1e-9)
    rows = {r["column"]: r for r in describe(df, ["x", "y", "z"]).collect()}
    assert rows["z"]["count"] == 0 and rows["z"].q50 is None
    assert (rows["x"].q25, rows["x"].q75, rows["x"].max) == pytest.approx((*np.quantile(x, [0.25, 0.75]), x.max()))


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(2.5,)], "x double")
    assert [r.value for r in exact_quantiles(df, ["x"], [0.25, 0.5]).collect()] == [2.5, 2.5]
    assert exact_quantiles(df.where("false"), ["x"], [0.5]).collect() == []
