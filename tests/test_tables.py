import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricetail.operators import groups
from pricetail.operators.cells import build_cells, build_modes, join_modes
from pricetail.operators.clean import Feed, clean_lines, null_tally
from pricetail.operators.dynamics import demean, group_mean_instrument, market_min_response
from pricetail.operators.groups import first_by, group_mode, group_modes, with_group_stats
from pricetail.operators.products import hash_sample, keep_listed, keep_members, sold_in_all, varied_products
from pricetail.operators.shares import histogram
from pricetail.schemas import CELLS, COMMON_SKUS
from pricetail.sources import read_csv_table, read_months, write_months


def lines(spark):
    rows = [
        # A week that straddles two months: 30 June and 1 July 2018 are a Saturday and a Sunday,
        # so use 31 July (Tuesday) and 1 August (Wednesday).
        (dt.date(2018, 7, 31), "1", 10000000, "Milk", 20.0, 2.0),
        (dt.date(2018, 8, 1), "1", 10000000, "Milk", 9.9, 1.0),
        (dt.date(2018, 8, 1), "1", 10000000, "Milk", 12.9, 1.0),
        (dt.date(2018, 8, 1), "1", 10000000, "flaskePANT", 3.0, 1.0),
        (dt.date(2018, 8, 1), "1", 10000000, "Bærepose", 3.0, 1.0),
        (dt.date(2018, 8, 1), "1", 10000000, None, 3.0, 1.0),
        (dt.date(2018, 8, 1), "1", 10000000, "Bread", 0.0, 1.0),
        (dt.date(2018, 8, 1), "1", 10000000, "Caviar", 1000.5, 1.0),
        (dt.date(2018, 5, 31), "1", 10000000, "Milk", 9.9, 1.0),
        (dt.date(2018, 12, 1), "1", 10000000, "Milk", 9.9, 1.0),
        (dt.date(2018, 8, 1), "2", 10000000, "Milk", 9.9, 0.0),
        (dt.date(2018, 8, 1), "3", 10000000, "Milk", 9.9, 1.0),
    ]
    schema = "date date, store_id string, sku_gtin long, sku_description string, sales double, quantity double"
    return spark.createDataFrame(rows, schema)


def stores(spark):
    rows = [("1", "kiwi", "NG"), ("2", "Extra", "Coop"), ("3", "other", "X"), ("1", "kiwi", "NG")]
    return spark.createDataFrame(rows, "id string, kjedeid string, paraplykjede string")


def test_cleaning_filters_and_union(spark):
    third = lines(spark).withColumnRenamed("store_id", "business_gln")
    third = third.unionByName(third.limit(1).withColumn("sku_gtin", F.lit(None).cast("long")))
    out = clean_lines(
        [Feed(lines(spark)), Feed(third, "business_gln", fixed_chain="Rema", require_sku=True)], stores(spark)
    )
    by_chain = {r["kjedeid"]: r["count"] for r in out.groupBy("kjedeid").count().collect()}
    # Store 3 has an unlisted chain: dropped from the first feed, kept in the third.
    assert by_chain == {"kiwi": 3, "Extra": 1, "Rema": 5}
    assert out.where("ppu = double('inf')").count() == 2


def test_cells_split_at_month_end_and_modes_tie(spark):
    clean = clean_lines([Feed(lines(spark))], stores(spark)).where("kjedeid = 'kiwi'")
    cells, modes = build_cells(clean), build_modes(clean)
    assert {(r.month, r.week, r.trans) for r in cells.collect()} == {(7, 30, 1), (8, 30, 2)}
    assert modes.count() == 3
    joined = join_modes(cells, modes)
    assert joined.count() == 3 and joined.where("ppu is null").count() == 0
    assert abs(cells.where("month = 8").first().price - 11.4) < 1e-9


def test_month_sink_and_pruned_read(spark, tmp_path):
    clean = clean_lines([Feed(lines(spark))], stores(spark))
    write_months(build_cells(clean), str(tmp_path / "cells"))
    back = read_months(spark, str(tmp_path / "cells"), [7], CELLS)
    assert [r.month for r in back.collect()] == [7]
    assert "PartitionFilters: [isnotnull(month" in back._jdf.queryExecution().toString()


def test_csv_with_semicolon(spark, tmp_path):
    (tmp_path / "skus.csv").write_text("sku_gtin\n1\n1\n2\n")
    skus = read_csv_table(spark, str(tmp_path / "skus.csv"), COMMON_SKUS, sep=";")
    rows = spark.createDataFrame([(1,), (2,), (3,)], "sku_gtin long")
    assert keep_listed(rows, skus, "sku_gtin").count() == 3
    assert keep_members(rows, skus, "sku_gtin").count() == 2


def test_null_tally(spark):
    df = spark.createDataFrame([(1,), (None,), (None,)], "a int")
    assert {r.missing: r.n for r in null_tally(df, "a").collect()} == {True: 2, False: 1}


@pytest.mark.parametrize("hot", [0, 1, 10_000])
def test_group_stats_equal_on_both_join_paths(spark, monkeypatch, hot):
    monkeypatch.setattr(groups, "HOT_GROUPS", hot)
    rows = [(i % 3 if i % 2 else 0, float(i)) for i in range(40)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = with_group_stats(df, ["k"], {"m": F.avg("v")}).collect()
    assert len(got) == 41
    means = {}
    for k, v in rows:
        means.setdefault(k, []).append(v)
    for r in got:
        if r.k is None:
            assert r.m is None
        else:
            assert abs(r.m - sum(means[r.k]) / len(means[r.k])) < 1e-9


def test_modes_take_the_smallest_on_ties(spark):
    df = spark.createDataFrame([(1, 5.0, "b"), (1, 3.0, "a"), (1, None, "a"), (2, None, None)], "k int, v double, t string")
    assert {r.k: r.v for r in group_mode(df, ["k"], "v").collect()} == {1: 3.0, 2: None}
    both = {r.k: (r.v, r.t) for r in group_modes(df, ["k"], ["v", "t"]).collect()}
    assert both == {1: (3.0, "a")}


def test_first_by_picks_one_whole_row(spark):
    df = spark.createDataFrame([(1, 2, "x"), (1, 1, "y"), (1, 1, "a")], "k int, o int, v string")
    assert [tuple(r) for r in first_by(df, ["k"], ["o"]).collect()] == [(1, 1, "a")]


def test_sold_in_all_and_varied(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "a", 2)], "s int, c string, w int")
    assert [r.s for r in sold_in_all(df, "s", "c").collect()] == [1]
    assert [r.s for r in sold_in_all(df, "s", "c", ["a"]).orderBy("s").collect()] == [1, 2]
    assert [r.s for r in varied_products(df, "s", ["c", "w"]).collect()] == [1]


def test_hash_sample_is_stable(spark):
    df = spark.range(20000).toDF("id")
    a = {r.id for r in hash_sample(df, ["id"], 0.1).collect()}
    b = {r.id for r in hash_sample(df.repartition(7), ["id"], 0.1).collect()}
    assert a == b and 1800 < len(a) < 2200


def test_market_minimum_lag_scopes_and_gap(spark):
    rows = [("a", 1, w, p, 1.0, 1, 1.0) for w, p in [(1, 10.0), (3, 9.0)]] + [("b", 1, 3, 19.0, 1.0, 1, 1.0)]
    df = spark.createDataFrame(rows, "kjedeid string, sku_gtin long, week int, ppu double, quantity double, trans long, sales double")
    own = {(r.kjedeid, r.week): r for r in market_min_response(df).collect()}
    assert own[("a", 3)].min_price_week_lag == 10.0 and own[("a", 3)].price_lower_lag
    assert own[("a", 3)].min_price_lag_int and own[("b", 3)].min_price_week_lag is None
    assert own[("b", 3)].price_at_min_lag is False
    across = {(r.kjedeid, r.week): r for r in market_min_response(df, "sku").collect()}
    assert across[("b", 3)].min_price_week_lag == 9.0


def test_leave_out_mean(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "x", 3.0), (1, "y", 8.0), (2, "x", 5.0)], "g int, s string, ppu double")
    got = {(r.g, r.s, r.ppu): r.price_iv for r in group_mean_instrument(df, ["g"], leave_out="s").collect()}
    assert got == {(1, "x", 1.0): 8.0, (1, "x", 3.0): 8.0, (1, "y", 8.0): 2.0, (2, "x", 5.0): None}


def test_demeaned_groups_have_zero_mean(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("g"), (F.col("id") * 1.5).alias("v"))
    worst = demean(df, ["v"], ["g"]).groupBy("g").agg(F.abs(F.avg("v_demeaned")).alias("m")).agg(F.max("m")).first()[0]
    assert worst < 1e-9


def test_histogram_edges_and_single_value(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.5), ("a", 1.0), ("b", 3.0)], "k string, v double")
    got = {(r.k, r.bin): r.n for r in histogram(df, "v", 2, ["k"]).collect()}
    assert got == {("a", 0): 1, ("a", 1): 2, ("b", 1): 1}
