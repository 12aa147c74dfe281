import math
import random

import numpy as np
import pytest

from pricetail.operators import geo


def brute(stores, radii=(2, 5, 10)):
    out = {}
    for i, x, y, chain in stores:
        if x is None:
            out[i] = (None, None, None, [None] * len(radii))
            continue
        others = [(math.sqrt((x - a) ** 2 + (y - b) ** 2), j, c, (a, b)) for j, a, b, c in stores if a is not None]
        nearest = min((d for d, j, _, _ in others if j != i), default=None)
        nonzero = min((d for d, _, _, p in others if p != (x, y)), default=None)
        rival = min((d for d, _, c, _ in others if chain and c and c != chain), default=None)
        counts = [sum(1 for d, _, c, _ in others if chain and c and c != chain and d <= r * 1000) for r in radii]
        out[i] = (nearest, nonzero, rival, counts)
    return out


@pytest.mark.parametrize("leaf, cells", [(2, 50_000), (3, 0)])
def test_against_brute_force_with_dense_town(spark, monkeypatch, leaf, cells):
    # A small leaf makes the search descend; no broadcast exercises the shuffle joins.
    monkeypatch.setattr(geo, "LEAF_PLACES", leaf)
    monkeypatch.setattr(geo, "BROADCAST_CELLS", cells)
    rng = random.Random(5)
    stores = [(i, rng.uniform(0, 40_000), rng.uniform(0, 40_000), f"c{i % 3}") for i in range(20)]
    # A dense town of one chain, two stores at one point, one without chain, one without place.
    stores += [(100 + i, 5_000 + rng.uniform(0, 60), 5_000 + rng.uniform(0, 60), "c0") for i in range(15)]
    stores += [(200, 5_000.0, 5_000.0, "c1"), (201, 5_000.0, 5_000.0, "c2"), (202, 5_001.0, 5_000.0, None)]
    stores += [(203, None, None, "c1")]
    df = spark.createDataFrame(stores, "id long, x double, y double, chain string")
    want = brute(stores)

    def check(found, pick):
        for r in found.collect():
            expected = want[r["id"]][pick]
            if expected is None:
                assert r["min_distance"] is None
            else:
                assert math.isclose(r["min_distance"], expected, rel_tol=1e-9, abs_tol=1e-9)

    check(geo.nearest_store(df, "id", "x", "y"), 0)
    check(geo.nearest_store(df, "id", "x", "y", exclude="zero"), 1)
    check(geo.nearest_store(df, "id", "x", "y", differ_on="chain"), 2)
    counted = geo.competitors_within(df, "id", "x", "y", "chain")
    for r in counted.collect():
        assert [r[f"competitors_within_{k}km"] for k in (2, 5, 10)] == want[r["id"]][3]


def test_bad_options(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double")
    with pytest.raises(ValueError):
        geo.nearest_store(df, "id", "x", "y", exclude="none")


def test_many_stores_at_one_point(spark):
    rows = [(i, 10.0, 20.0) for i in range(5000)] + [(9001, 13.0, 24.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r["id"]: r["min_distance"] for r in geo.nearest_store(df, "id", "x", "y").collect()}
    assert got.pop(9001) == 5.0 and set(got.values()) == {0.0} and len(got) == 5000


def test_dense_place_with_far_outlier(spark):
    # A millimetre full of stores and one store 1,000 km away: cells follow the stores.
    rng = np.random.default_rng(3)
    at = np.concatenate([rng.uniform(0, 1e-3, (5_000, 2)), [[1e6, 1e6]]])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id long, x double, y double")
    tree = geo._Tree(df.select(geo.F.col("x").alias("px"), geo.F.col("y").alias("py"), geo.F.lit(1).alias("weight"), geo.F.lit("").alias("label")), [])
    assert tree.depth <= 7 and tree.cells[-1].agg({"places": "max"}).first()[0] <= geo.LEAF_PLACES
    got = np.array([r[1] for r in geo.nearest_store(df, "id", "x", "y").orderBy("id").select("id", "min_distance").collect()])
    want = np.empty(len(at))
    for lo in range(0, len(at), 500):
        d2 = ((at[lo : lo + 500, None, :] - at[None, :, :]) ** 2).sum(axis=2)
        d2[np.arange(len(d2)), np.arange(lo, lo + len(d2))] = np.inf
        want[lo : lo + 500] = np.sqrt(d2.min(axis=1))
    assert np.allclose(got, want, rtol=1e-12, atol=0)


def test_ties_along_both_axes_and_no_finite_place(spark, monkeypatch):
    # Most stores share x or y, so that quartiles fall together; some have no finite place.
    monkeypatch.setattr(geo, "LEAF_PLACES", 2)
    stores = [(i, 5.0, float(i), "a") for i in range(30)] + [(100 + i, float(i), 7.0, "b") for i in range(30) if i != 5]
    odd = [(200, float("nan"), 1.0, "a"), (201, float("inf"), 1.0, "b"), (202, 1.0, None, "a")]
    df = spark.createDataFrame(stores + odd, "id long, x double, y double, chain string")
    want = brute(stores)
    for r in geo.nearest_store(df, "id", "x", "y", differ_on="chain").collect():
        assert r["min_distance"] == (want[r["id"]][2] if r["id"] < 200 else None)
    for r in geo.competitors_within(df, "id", "x", "y", "chain", [0.002, 0.01]).collect():
        expected = [sum(1 for _, a, b, c in stores if c != r["chain"] and math.hypot(a - r["x"], b - r["y"]) <= k) for k in (2, 10)] if r["id"] < 200 else [None, None]
        assert [r["competitors_within_0.002km"], r["competitors_within_0.01km"]] == expected


def test_later_searches_do_not_run_earlier_ones_again(spark, monkeypatch):
    """Towns of one chain each, blocks of a few stores; what a search found is kept, not planned again."""
    monkeypatch.setattr(geo, "LEAF_PLACES", 8)
    rng = random.Random(9)
    towns = [(rng.uniform(0, 50_000), rng.uniform(0, 50_000)) for _ in range(6)]
    stores = [(i, towns[i % 6][0] + rng.uniform(0, 900), towns[i % 6][1] + rng.uniform(0, 900), f"c{i % 3}") for i in range(60)]
    df = spark.createDataFrame(stores, "id long, x double, y double, chain string")
    counted = geo.competitors_within(df, "id", "x", "y", "chain")
    found = geo.nearest_store(geo.nearest_store(counted, "id", "x", "y", name="any"), "id", "x", "y", differ_on="chain", name="rival")
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = brute(stores)
    for r in found.collect():
        assert math.isclose(r["any"], want[r["id"]][0]) and math.isclose(r["rival"], want[r["id"]][2])
        assert [r[f"competitors_within_{k}km"] for k in (2, 5, 10)] == want[r["id"]][3]
