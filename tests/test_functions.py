import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricetail.functions import (
    chain_format,
    chain_owner,
    digit_count_in,
    ends_cent_nine,
    ends_unit_nine,
    format_estimate,
    is_finite,
    stars,
    to_long_or_null,
    unit_price,
    week_of_year_sunday,
)

PRICES = [9.0, 19.9, 90.0, 99.9, 12.19, 12.95, 12.29, 89.5, None, float("inf"), float("nan"), 10000009.19]
NAN = float("nan")


def python_b(p):
    whole = int(p)
    return whole % 10 == 9 and whole < 90, round(p * 100) % 100 in (90, 95, 99)


def flags(spark, kind):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PRICES)], "i int, p double")
    p = F.col("p")
    rows = df.select("i", ends_unit_nine(p, kind).alias("u"), ends_cent_nine(p, kind).alias("c")).orderBy("i")
    return [(r.u, r.c) for r in rows.collect()]


def test_endings_b_and_c(spark):
    b, c = flags(spark, "B"), flags(spark, "C")
    for price, got_b, got_c in zip(PRICES, b, c):
        if price is None or price != price or price == float("inf"):
            assert got_b == (None, None) and got_c == (False, False)
        else:
            assert got_b == got_c == python_b(price)


def test_endings_a(spark):
    got = flags(spark, "A")
    assert got[0] == (True, False)
    assert got[1] == (True, True)
    assert got[3] == (True, True)
    assert got[4] == (False, False)
    assert got[8] == (None, None)


def test_endings_d_reads_the_printed_price(spark):
    got = dict(zip([str(p) for p in PRICES], flags(spark, "D")))
    assert got["9.0"] == (True, False)
    assert got["19.9"] == (True, True)
    assert got["99.9"] == (True, True)
    assert got["12.19"] == (False, True)
    assert got["12.95"] == (False, True)
    assert got["10000009.19"] == (True, True)
    assert got["None"] == got["inf"] == got["nan"] == (False, False)


def test_endings_d_of_huge_prices_are_unknown(spark):
    rows = [(0, 1e16), (1, 9.9e15), (2, 1e300), (3, -1e16), (4, 9999999999999999.0)]
    p = F.col("p")
    df = spark.createDataFrame(rows, "i int, p double").select("i", ends_unit_nine(p, "D"), ends_cent_nine(p, "D"))
    got = {r[0]: tuple(r)[1:] for r in df.collect()}
    # The last one is the same double as 1e16.
    assert got[0] == got[2] == got[3] == got[4] == (None, None)
    assert got[1] == (False, False)


def test_unknown_ending_kind():
    with pytest.raises(Exception):
        ends_unit_nine(F.col("p"), "Z")


def test_week_matches_strftime(spark):
    days = [dt.date(2016, 12, 20) + dt.timedelta(days=i) for i in range(900)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select("d", week_of_year_sunday(F.col("d")).alias("w"))
    assert all(int(r.d.strftime("%U")) == r.w for r in df.collect())


def test_unit_price_of_zero_quantity_is_infinite(spark):
    df = spark.createDataFrame([(10.0, 2.0), (10.0, 0.0), (0.0, 0.0), (None, 0.0)], "s double, q double")
    got = [r[0] for r in df.select(unit_price(F.col("s"), F.col("q"))).collect()]
    assert got[0] == 5.0 and got[1] == float("inf") and got[2] != got[2] and got[3] is None
    finite = df.where(is_finite(unit_price(F.col("s"), F.col("q")))).count()
    assert finite == 1


def test_code_lengths(spark):
    df = spark.createDataFrame([(1234567,), (12345678,), (123456789012,), (1234567890123,)], "c long")
    assert [r[0] for r in df.select(digit_count_in(F.col("c"), [8, 13])).collect()] == [False, True, False, True]


def test_labels(spark):
    df = spark.createDataFrame([("Rema",), ("spar",), ("Obs",), ("unknown",), (None,)], "c string")
    c = F.col("c")
    rows = df.select(chain_owner(c), chain_format(c), chain_format(c, "discount")).collect()
    assert [tuple(r) for r in rows] == [
        ("Rema", "discounter", "discount"),
        ("NG", "supermarket", "supermarket"),
        ("Coop", "hypermarket", "hypermarket"),
        (None, None, None),
        (None, None, None),
    ]


def test_stars_and_entries(spark):
    df = spark.createDataFrame([(2.6, 1.0), (-2.0, 1.0), (1.7, 1.0), (1.0, 1.0), (1.0, 0.0)], "e double, s double")
    assert [r[0] for r in df.select(stars(F.col("e"), F.col("s"))).collect()] == ["***", "**", "*", "", ""]
    assert df.select(format_estimate(F.col("e"), F.col("s"))).first()[0] == "2.600***\n(1.000)"


def test_to_long_or_null(spark):
    df = spark.createDataFrame([("12",), ("",), ("ab",), ("7.0",)], "t string")
    assert [r[0] for r in df.select(to_long_or_null(F.col("t"))).collect()] == [12, None, None, 7]


def test_mean_cents_ties_go_up_whatever_the_order(spark):
    from pricetail.operators.cells import mean_cents

    rows = [("a", 1.0), ("a", 1.01), ("b", -1.0), ("b", -1.01), ("c", None), ("d", float("inf")), ("d", 2.995), ("e", 0.1), ("e", 0.2), ("e", 0.2)]
    df = spark.createDataFrame(rows, "k string, ppu double")
    expected = {"a": 101, "b": -100, "c": None, "d": 300, "e": 17}
    for parts in (1, 5):
        assert {r.k: r.mean_cents for r in mean_cents(df.repartition(parts), ["k"]).collect()} == expected
    assert mean_cents(df.limit(0), ["k"]).count() == 0
