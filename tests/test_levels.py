"""Components of levels, their rank, rows alone at a level, comparable effects."""

import random

import numpy as np
import pandas as pd
import pytest

from pricetail.operators import levels as V
from pricetail.operators.regress import fe_ols


def panel(seed, n=60, a=25, b=20, c=3):
    rng = np.random.default_rng(seed)
    p = pd.DataFrame({"a": rng.integers(0, a, n), "b": [f"b{k}" for k in rng.integers(0, b, n)], "c": rng.integers(0, c, n), "g": rng.integers(0, 2, n)})
    return p.assign(x=rng.normal(size=n), y=rng.normal(size=n))


def dummies(p, dims):
    return np.column_stack([pd.get_dummies(p[d]).to_numpy(dtype=float) for d in dims])


def test_connected(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7)]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for u, v in links:
        if u != v:
            x, y = sorted((root(u), root(v)))
            parent[y] = x
    got = {r.node: r.part for r in V.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: root(v) for v in parent}
    assert V.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rank_equals_dummy_matrix(spark):
    """The standard error shows the rank: one more or less would change it by a per cent."""
    p = panel(0)
    p["d"] = p["a"] // 5  # nested in a, so it adds nothing
    df = spark.createDataFrame(p)
    for dims in (["a", "b"], ["d", "c", "a", "b"]):
        fit = fe_ols(df, "y", ["x"], absorb=dims, fe_dof="exact")
        rank = np.linalg.matrix_rank(dummies(p, dims))
        x = np.column_stack([p.x, dummies(p, dims)])
        left = p.y - x @ np.linalg.lstsq(x, p.y, rcond=None)[0]
        inner = p.x - dummies(p, dims) @ np.linalg.lstsq(dummies(p, dims), p.x, rcond=None)[0]
        se = np.sqrt(left @ left / (len(p) - 1 - rank) / (inner @ inner))
        assert fit.tidy().first().std_error == pytest.approx(se, rel=1e-5)


def test_rank_by_group(spark):
    p = panel(5, 80)
    fit = fe_ols(spark.createDataFrame(p), "y", ["x"], absorb=["a", "b"], by=["g"])
    got = {r.g: r.levels for r in V.absorbed_rank(fit.panel).collect()}
    assert got == {g: np.linalg.matrix_rank(dummies(q, ["a", "b"])) for g, q in p.groupby("g")}


def test_rows_alone_at_a_level(spark):
    p = panel(7)
    q = p
    while True:
        kept = q[q.groupby("a").a.transform("size").gt(1) & q.groupby("b").b.transform("size").gt(1)]
        if len(kept) == len(q):
            break
        q = kept
    assert 0 < len(q) < len(p)
    one = fe_ols(spark.createDataFrame(p), "y", ["x"], absorb=["a", "b"], drop_singletons=True).tidy().first()
    other = fe_ols(spark.createDataFrame(q), "y", ["x"], absorb=["a", "b"]).tidy().first()
    assert one.n_obs == len(q)
    assert (one.estimate, one.std_error) == pytest.approx((other.estimate, other.std_error), rel=1e-6)


def test_effects_have_the_smallest_norm_in_each_component(spark):
    p = panel(9, 30)
    fit = fe_ols(spark.createDataFrame(p), "y", ["x"], absorb=["a", "b"])
    one, other = ({r[0]: (r.effect, r.component) for r in t.select(k, "effect", "component").collect()} for t, k in zip(V.component_effects(fit), "ab"))
    assert len({c for _, c in one.values()}) > 1
    d = dummies(p, ["a", "b"])
    left = p.y - fit.coefficients()["x"] * p.x
    smallest = np.linalg.lstsq(d, left, rcond=None)[0]
    levels = [*sorted(one), *sorted(other)]
    assert len(levels) == d.shape[1]
    got = [(one | other)[k][0] for k in levels]
    assert np.allclose(got, smallest, atol=1e-6)
    assert all(one[a][1] == other[b][1] for a, b in zip(p.a, p.b))
