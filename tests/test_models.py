import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricetail.operators import absorb, regress
from pricetail.operators.bins import bin_effects, bin_linear_fit, fit_bins
from pricetail.operators.decompose import STANDARD_STEPS, variance_decomposition
from pricetail.operators.regress import Factor, fe_ols, fixed_effects, iv_2sls, model_table, with_fitted


def panel(n=600, seed=3):
    rng = np.random.default_rng(seed)
    sku, store, week = rng.integers(0, 12, n), rng.integers(0, 9, n), rng.integers(0, 5, n)
    # One product holds a third of the rows.
    sku = np.where(rng.random(n) < 1 / 3, 0, sku)
    z, u = rng.normal(size=n), rng.normal(size=n)
    x = 0.7 * z + 0.1 * sku + 0.5 * u
    flag = (rng.random(n) < 0.3).astype(float)
    y = -1.2 * x + 0.4 * flag + 0.3 * sku - 0.2 * store + 0.05 * week + u
    return pd.DataFrame({"sku": sku, "store": store, "week": week, "chain": store % 3, "z": z, "x": x, "flag": flag, "y": y})


def dense(p, y, x, dims, z=None):
    dummies = [pd.get_dummies(p[d].astype(str), drop_first=i > 0).astype(float).values for i, d in enumerate(dims)]
    fixed = np.column_stack(dummies) if dummies else np.ones((len(p), 1))
    xs, zs = np.column_stack([p[x].values, fixed]), np.column_stack([p[z or x].values, fixed])
    proj = zs @ np.linalg.pinv(zs.T @ zs) @ (zs.T @ xs)
    inv = np.linalg.pinv(proj.T @ proj)
    beta = inv @ (proj.T @ p[y].values)
    return beta, p[y].values - xs @ beta, proj, inv


def one_way(p, proj, inv, e, cluster, k):
    s = pd.DataFrame(proj * e[:, None]).groupby([p[c].values for c in cluster]).sum().values
    g, n = len(s), len(p)
    return g, inv @ (s.T @ s) @ inv * (n - 1) / (n - k)


def results(fit):
    return {r["term"]: (r["estimate"], r["std_error"]) for r in fit.tidy().collect()}


DIMS = ["sku", "store", "week"]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_three_way_effects_match_dummies(spark, monkeypatch, limit):
    # Without a broadcast budget every effect table takes the salted shuffle path.
    monkeypatch.setattr(absorb, "BROADCAST_BYTES", limit)
    p = panel()
    df = spark.createDataFrame(p)
    beta, e, proj, inv = dense(p, "y", ["x", "flag"], DIMS)
    fit = fe_ols(df, "y", ["x", "flag"], (), DIMS)
    got = results(fit)
    k = proj.shape[1]
    se = np.sqrt(np.diag(inv) * (e @ e) / (len(p) - k))
    for i, term in enumerate(["x", "flag"]):
        assert np.allclose(got[term], (beta[i], se[i]), atol=1e-6)
    resid = with_fitted(df, fit, "hat", "res").toPandas()
    assert np.allclose(np.sort(resid["res"]), np.sort(e), atol=1e-6)
    assert abs((resid["res"] * resid["x"]).sum()) < 1e-5
    assert resid.groupby("sku")["res"].mean().abs().max() < 1e-6


def test_cluster_errors_one_and_two_way(spark):
    p = panel()
    df = spark.createDataFrame(p)
    beta, e, proj, inv = dense(p, "y", ["x", "flag"], ["sku", "store"])
    k = proj.shape[1]
    got = results(fe_ols(df, "y", ["x", "flag"], (), ["sku", "store"], ["store"], vcov="cluster"))
    g, v = one_way(p, proj, inv, e, ["store"], k)
    assert np.allclose([got["x"][1], got["flag"][1]], np.sqrt(np.diag(v * g / (g - 1)))[:2], atol=1e-6)
    got = results(fe_ols(df, "y", ["x", "flag"], (), ["sku", "store"], ["sku", "store"], vcov="cluster"))
    parts = [one_way(p, proj, inv, e, c, k) for c in (["sku"], ["store"], ["sku", "store"])]
    g = min(parts[0][0], parts[1][0])
    v = (parts[0][1] + parts[1][1] - parts[2][1]) * g / (g - 1)
    assert np.allclose([got["x"][1], got["flag"][1]], np.sqrt(np.diag(v))[:2], atol=1e-6)


def test_instruments(spark):
    p = panel()
    beta, e, proj, inv = dense(p, "y", ["x", "flag"], ["sku", "store"], ["z", "flag"])
    fit = iv_2sls(spark.createDataFrame(p), "y", ["x"], ["z"], ["flag"], ["sku", "store"], ["store"], vcov="cluster")
    g, v = one_way(p, proj, inv, e, ["store"], proj.shape[1])
    got = results(fit)
    assert np.allclose([got["x"][0], got["flag"][0]], beta[:2], atol=1e-6)
    assert np.allclose([got["x"][1], got["flag"][1]], np.sqrt(np.diag(v * g / (g - 1)))[:2], atol=1e-6)


def test_groups_equal_separate_fits(spark):
    df = spark.createDataFrame(panel())
    together = fe_ols(df, "y", ["x", "flag"], (), ["sku", "week"], ["store"], ["chain"], "cluster").tidy()
    for chain in (0, 1, 2):
        alone = results(fe_ols(df.where(F.col("chain") == chain), "y", ["x", "flag"], (), ["sku", "week"], ["store"], vcov="cluster"))
        for r in together.where(F.col("chain") == chain).collect():
            assert np.allclose(alone[r["term"]], (r["estimate"], r["std_error"]), atol=1e-6)


def test_many_dummies_use_the_wide_path(spark, monkeypatch):
    p = panel()
    df = spark.createDataFrame(p)
    want = results(fe_ols(df, "y", ["x"], [Factor("sku", 3)], (), ["store"], vcov="cluster"))
    monkeypatch.setattr(regress, "SQL_COLUMNS", 1)
    got = results(fe_ols(df, "y", ["x"], [Factor("sku", 3)], (), ["store"], vcov="cluster"))
    assert want.keys() == got.keys() and "sku[3]" not in got
    assert all(np.allclose(want[t], got[t], atol=1e-8) for t in want)


def test_collinear_terms_are_listed_without_estimate(spark):
    p = panel()
    p["copy"] = 2 * p["x"]
    got = results(fe_ols(spark.createDataFrame(p), "y", ["x", "copy"], (), ["sku"]))
    assert got["copy"] == (None, None) and got["x"][0] is not None


def test_one_way_effects_are_group_means(spark):
    p = panel()
    fit = fe_ols(spark.createDataFrame(p), "y", ["x"], (), ["sku"])
    b = fit.coefficients()["x"]
    want = (p["y"] - b * p["x"]).groupby(p["sku"]).mean()
    for r in fixed_effects(fit, 0).collect():
        assert abs(r["effect"] - want[r["sku"]]) < 1e-9


def test_missing_and_infinite_rows_are_left_out(spark):
    p = panel(200)
    df = spark.createDataFrame(p)
    bad = df.limit(3).withColumn("x", F.lit(float("inf"))).unionByName(df.limit(2).withColumn("y", F.lit(None).cast("double")))
    fit = fe_ols(df.unionByName(bad), "y", ["x"], (), ["sku"])
    assert fit.groups[0].n_obs == 200


def test_bins_and_lines(spark):
    rows = [(float(b), b * 0.5 + (i % 2) * 0.1, i % 4) for b in range(1, 15) for i in range(8)]
    df = spark.createDataFrame(rows, "floor double, y double, g int")
    effects = bin_effects(fit_bins(df, "y", "floor", ["g"]))
    table = {r["bin"]: r for r in effects.collect()}
    assert 1.0 not in table and abs(table[9.0]["estimate"] - 4.0) < 1e-6
    assert table[9.0]["isnine"] == 1 and table[10.0]["iszero"] == 1 and abs(table[9.0]["diff"] - 0.5) < 1e-6
    slopes = {r["group"]: r["slope"] for r in bin_linear_fit(effects).collect()}
    assert abs(slopes[0.0] - 0.5) < 1e-6 and abs(slopes[10.0] - 0.5) < 1e-6


def test_decomposition_first_step_is_exact_on_balanced_data(spark):
    rng = np.random.default_rng(1)
    rows = [
        (c, w, s, c * 10 + st, float(rng.random() < 0.2 + 0.15 * s))
        for c in range(2) for w in range(3) for s in range(3) for st in range(2) for _ in range(3)
    ]
    p = pd.DataFrame(rows, columns=["chain", "week", "product", "store", "flag"])
    got = {r["component"]: r["variance"] for r in variance_decomposition(spark.createDataFrame(p), "flag", STANDARD_STEPS).collect()}
    for name in ("week", "product", "chain"):
        assert abs(got[name] - p.groupby(name)["flag"].transform("mean").var()) < 1e-9
    assert got["residual"] <= p["flag"].var()


def test_model_table(spark):
    df = spark.createDataFrame([("a", "m1", 1.0, 0.1), ("a", "m2", 2.0, 5.0)], "term string, model string, estimate double, std_error double")
    row = model_table(df, "model", ["m1", "m2"]).first()
    assert row["m1"] == "1.000***\n(0.100)" and row["m2"] == "2.000\n(5.000)"


def test_vectors_and_tables_of_effects_agree(spark, monkeypatch):
    """Sweeps on the driver's vectors and on tables have the same limit, split of constants included."""
    from pricetail.operators import absorb as A

    rng = np.random.default_rng(8)
    rows = [(int(a), f"s{b}", int(c), float(y), int(a) % 2) for a, b, c, y in zip(rng.integers(0, 9, 300), rng.integers(0, 7, 300), rng.integers(0, 4, 300), rng.normal(5, 2, 300))]
    df = spark.createDataFrame(rows, "a int, b string, c int, y double, g int")
    dims = [["a"], ["b"], ["c", "b"]]
    records = A.materialise(A.collapse(df, ["g", "a", "b", "c"], ["y"]))
    found = []
    for held in (A.HELD_CELLS, 0):
        monkeypatch.setattr(A, "HELD_CELLS", held)
        effects = A.absorb(records, ["g"], dims, ["y"], ["g", "a", "b", "c"], tol=1e-11)
        found.append([{tuple(r[k] for k in e.keys): (r.y, r._records) for r in e.table.collect()} for e in effects])
    for mine, theirs in zip(*found):
        assert mine.keys() == theirs.keys()
        for key, (value, n) in mine.items():
            assert n == theirs[key][1] and abs(value - theirs[key][0]) < 1e-7


def test_extrapolation_finds_the_fixed_point():
    from pricetail.operators.absorb import Extrapolation

    rng = np.random.default_rng(3)
    turn = rng.normal(size=(12, 12))
    turn = 0.97 * (turn + turn.T) / np.abs(np.linalg.eigvalsh(turn + turn.T)).max()
    aim = rng.normal(size=12)
    at, mixer = np.zeros(12), Extrapolation(8)
    for _ in range(40):
        after = aim + turn @ (at - aim)
        at = mixer.next(at, after)
    assert np.abs(at - aim).max() < 1e-8


@pytest.mark.parametrize("order", [["g", "b", "c"], ["b", "g", "c"], ["b", "c", "g"]])
def test_largest_dimension_never_reaches_the_driver(spark, monkeypatch, order):
    """Levels of ``g`` name their level of ``b``, which both could carry: the first listed one does."""
    import pricetail.operators.absorb as A

    rng = np.random.default_rng(5)
    b = rng.integers(0, 4, 400)
    p = pd.DataFrame({"b": [f"b{k}" for k in b], "g": b * 20 + rng.integers(0, 20, 400) ** 2 // 20, "c": rng.integers(0, 6, 400) % (2 + b)})
    p = p.assign(k=rng.integers(0, 3, 400), y=1e3 + rng.normal(size=400) + b + 0.3 * p["c"], x=rng.normal(size=400) + 0.1 * p["g"])
    monkeypatch.setattr(A, "CROSSED_CELLS", 100)
    records = A.materialise(A.collapse(spark.createDataFrame(p), ["b", "g", "c", "k"], ["x", "y"]))
    with monkeypatch.context() as m:
        m.setattr(A, "_swept_vectors", None)
        found = A.absorb(records, [], [[d] for d in order], ["x", "y"], ["b", "g", "c", "k"])
    # All as vectors, as where two dimensions have many levels.
    monkeypatch.setattr(A, "FEW_LEVELS", 0)
    found += A.absorb(records, [], [[d] for d in order], ["x", "y"], ["b", "g", "c", "k"])
    left, want = p[["x", "y"]].to_numpy(), {d: np.zeros((400, 2)) for d in order}
    for _ in range(400):
        for d in order:
            mean = pd.DataFrame(left).groupby(p[d]).transform("mean").to_numpy()
            left, want[d] = left - mean, want[d] + mean
    for d, effects in zip(order * 2, found):
        got = effects.table.toPandas().set_index(d)
        assert effects.levels == len(got) == p[d].nunique() and got["_records"].sum() == records.count()
        assert np.allclose(got.loc[p[d], ["x", "y"]].to_numpy(), want[d], atol=1e-6)


@pytest.mark.parametrize("replayed", [4, 24])
def test_levels_of_a_shared_group_never_reach_the_driver(spark, monkeypatch, replayed):
    """Store by product and store by week are swept inside their stores, with the split of plain sweeps."""
    import pricetail.operators.absorb as A

    rng = np.random.default_rng(11)
    store = rng.integers(0, 30, 900) ** 2 // 30
    p = pd.DataFrame({"store": [f"s{k}" for k in store], "product": rng.integers(0, 5, 900), "week": [f"w{k}" for k in rng.integers(0, 4, 900)]})
    p = p.assign(k=rng.integers(0, 2, 900), y=rng.normal(size=900) + 0.2 * p["product"] * store, x=100 + rng.normal(size=900))
    keys = ["store", "product", "week", "k"]
    dims = list(STANDARD_STEPS[3].values())
    records = A.materialise(A.collapse(spark.createDataFrame(p), keys, ["x", "y"]))
    monkeypatch.setattr(A, "FEW_LEVELS", 20)
    monkeypatch.setattr(A, "SWEPT_CELLS", 60)
    monkeypatch.setattr(A, "REPLAYED", replayed)
    monkeypatch.setattr(A, "_swept_vectors", None)
    found = A.absorb(records, [], dims, ["x", "y"], keys)
    left, want = p[["x", "y"]].to_numpy(), [np.zeros((900, 2)) for _ in dims]
    for _ in range(400):
        for d, dim in enumerate(dims):
            mean = pd.DataFrame(left).groupby([p[k] for k in dim]).transform("mean").to_numpy()
            left, want[d] = left - mean, want[d] + mean
    for d, (dim, effects) in enumerate(zip(dims, found)):
        got = effects.table.toPandas().set_index(dim)
        assert effects.levels == len(got) == p.groupby(dim).ngroups and got["_records"].sum() == records.count()
        assert np.allclose(got.loc[list(zip(*[p[k] for k in dim])), ["x", "y"]].to_numpy(), want[d], atol=1e-6)
