"""Whole studies on made-up tables, against other ways to the same result."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest

from pricetail.operators import absorb
from pricetail.operators.decompose import STANDARD_STEPS
from pricetail.plans import load_all


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Purchases of 24 stores in five weeks, as events, and a product table that lists every other product.

    One of the listed products is sold in a single store.
    """
    rng = np.random.default_rng(4)
    n = 2400
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=int(k)) for k in rng.integers(0, 30, n)]
    store, product = rng.integers(0, 24, n), rng.integers(0, 16, n)
    product[(store == 7) & (product < 2)] = 18
    events = pd.DataFrame({"event_id": np.arange(n), "ts": days, "user_id": store, "event_type": "view"})
    events["value"], events["props"] = rng.choice([3, 7, 9, 12, 19], n) + 0.25, [f'{{"k": {k}}}' for k in product]
    folder = tmp_path_factory.mktemp("tables")
    for name, table in {"events": events, "part": pd.DataFrame({"p_partkey": range(20), "p_size": [20, 30] * 10})}.items():
        table.to_parquet(folder / f"{name}.parquet", index=False, coerce_timestamps="us")
    return str(folder)


def rows(registry, tables, name):
    con = duckdb.connect()
    for table in ("events", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet'")
    return con.execute(registry.ORACLES[name]).df()


def test_every_chain_has_its_elasticities(spark, tables):
    registry = load_all()
    got = registry.QUERIES["elasticity_by_chain_table"](spark, tables).toPandas().set_index("term")
    assert sorted(got.columns) == [f"chain_{i}" for i in range(5)]
    assert len(got) == 5 and got.notna().all(axis=None)
    want = rows(registry, tables, "elasticity_by_chain_table").set_index("term")
    assert (got.loc[want.index, want.columns] == want).all(axis=None)


def test_decomposition_has_listed_varied_products_one_by_one(spark, tables):
    """All four steps against plain sweeps, run until nothing moves."""
    e = pd.read_parquet(f"{tables}/events.parquet")
    e["product"], e["week"] = e["props"].str.extract(r"(\d+)")[0].astype(int), e["ts"].dt.strftime("%U")
    e["ppu"] = e["value"] // 1 + np.array([0.0, 0.5, 0.9, 0.95])[e["event_id"] % 4]
    counts = e.groupby(["week", "product", "user_id", "ppu"]).size().rename("n").reset_index()
    modes = counts[counts["n"] == counts.groupby(["week", "product", "user_id"])["n"].transform("max")]
    listed = modes[modes["product"] % 2 == 0]
    several = listed.groupby("product")[["user_id", "week"]].nunique().min(axis=1) > 1
    assert several.sum() == 8 and not several[18]
    cells = listed[listed["product"].map(several)].rename(columns={"user_id": "store"})
    cells = cells.assign(chain=cells["store"] % 5)
    flag = (cells["ppu"] // 1 % 10 == 9).to_numpy(dtype="float64")
    left, want = flag.copy(), {}
    for step in STANDARD_STEPS:
        levels = {name: cells.groupby(dim).ngroup().to_numpy() for name, dim in step.items()}
        effects = {name: np.zeros(len(cells)) for name in step}
        for _ in range(5000):
            for name, at in levels.items():
                mean = (np.bincount(at, weights=left) / np.bincount(at))[at]
                left, effects[name] = left - mean, effects[name] + mean
        want |= {name: effect.var(ddof=1) for name, effect in effects.items()}
    want["residual"] = left.var(ddof=1)
    got = load_all().QUERIES["variance_shares"](spark, tables).toPandas().set_index("component")
    assert sorted(got.index) == sorted(want)
    for name, variance in want.items():
        assert np.allclose(got.loc[name, ["variance", "share"]].tolist(), [variance, variance / flag.var(ddof=1)], atol=2e-6)


def test_more_than_few_products_by_week_are_swept_in_their_stores(spark, monkeypatch):
    rng = np.random.default_rng(6)
    p = pd.DataFrame({k: rng.integers(0, n, 240) for k, n in {"store": 8, "product": 6, "week": 4}.items()}).drop_duplicates()
    p["y"] = rng.normal(size=len(p))
    dims = list(STANDARD_STEPS[3].values())
    monkeypatch.setattr(absorb, "FEW_LEVELS", 4)
    monkeypatch.setattr(absorb, "_swept_vectors", None)
    found = absorb.absorb(spark.createDataFrame(p.assign(n=1)), [], dims, ["y"], ["store", "product", "week"])
    left, want = p["y"].to_numpy(), [np.zeros(len(p)) for _ in dims]
    codes = [p.groupby(dim).ngroup().to_numpy() for dim in dims]
    for _ in range(2000):
        for d, at in enumerate(codes):
            mean = (np.bincount(at, weights=left) / np.bincount(at))[at]
            left, want[d] = left - mean, want[d] + mean
    for dim, effects, effect in zip(dims, found, want):
        got = p[dim].merge(effects.table.toPandas(), on=dim, how="left")
        assert np.allclose(got["y"], effect, atol=1e-6)
