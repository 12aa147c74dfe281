"""Instruments, market minimum, product paths, discounts and demeaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.dynamics import (
    demean,
    demean_in_turn,
    discounts,
    group_mean_instrument,
    market_min_response,
    product_dynamics,
)
from . import views
from .registry import query, rounded, sql_r6
from .share_queries import CELLS_B_SQL, cells_b
from .views import PRICE_CELLS_SQL, PRICE_OBS_SQL

IV_GROUP = ["sku_gtin", "week", "kjedeid"]
CELL = "month, week, sku_gtin, store_id"


@query(
    "price_iv_mean",
    f"""WITH {PRICE_CELLS_SQL}
SELECT {CELL}, ppu, {sql_r6("avg(ppu) OVER (PARTITION BY sku_gtin, week, kjedeid)")} AS price_iv FROM price_cells""",
)
def price_iv_mean(spark, sf_dir):
    table = group_mean_instrument(views.price_cells(spark, sf_dir), IV_GROUP)
    return rounded(table, ["price_iv"]).select(*CELL.split(", "), "ppu", "price_iv")


def _register_leave_out(name, column):
    own = f"PARTITION BY sku_gtin, week, kjedeid, {column}"
    group = "PARTITION BY sku_gtin, week, kjedeid"

    @query(
        name,
        f"""WITH {PRICE_OBS_SQL}, s AS (
  SELECT event_id, sum(ppu) OVER ({group}) - sum(ppu) OVER ({own}) AS a,
         count(ppu) OVER ({group}) - count(ppu) OVER ({own}) AS b FROM price_obs)
SELECT event_id, CASE WHEN b > 0 THEN {sql_r6("a / b")} END AS price_iv FROM s""",
    )
    def leave_out(spark, sf_dir):
        lines = views.price_obs(spark, sf_dir)
        table = group_mean_instrument(lines, IV_GROUP, leave_out=column)
        return rounded(table, ["price_iv"]).select("event_id", "price_iv")


_register_leave_out("price_iv_leave_out_store", "store_id")
_register_leave_out("price_iv_leave_out_municipality", "municipality")


def _market_min_sql(order, product="sku_gtin"):
    return f"""WITH {CELLS_B_SQL}, products AS (SELECT * REPLACE ({product} AS sku_gtin) FROM flagged), counted AS (
  SELECT kjedeid, sku_gtin, week, ppu, count(*) AS n, sum(quantity) AS q, sum(trans) AS t, sum(sales) AS s
  FROM products GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY kjedeid, sku_gtin, week ORDER BY n DESC, ppu) AS rn,
    sum(q) OVER (PARTITION BY kjedeid, sku_gtin, week) AS quantity,
    CAST(sum(t) OVER (PARTITION BY kjedeid, sku_gtin, week) AS BIGINT) AS trans,
    sum(s) OVER (PARTITION BY kjedeid, sku_gtin, week) AS sales FROM counted),
market AS (SELECT kjedeid, sku_gtin, week, ppu, quantity, trans, sales,
    min(ppu) OVER (PARTITION BY sku_gtin, week) AS min_price_week FROM ranked WHERE rn = 1),
lagged AS (SELECT *, lag(min_price_week) OVER ({order}) AS lagp FROM market)
SELECT kjedeid, sku_gtin, week, ppu, quantity, trans, {sql_r6("sales")} AS sales, min_price_week,
  lagp AS min_price_week_lag, coalesce(ppu = lagp, false) AS price_at_min_lag,
  coalesce(ppu < lagp, false) AS price_lower_lag, coalesce(ppu > lagp, false) AS price_higher_lag,
  coalesce(CAST(trunc(lagp) AS BIGINT) % 10 = 9 AND lagp < 90, false) AS min_price_lag_ldp,
  coalesce(lagp % 10 = 0, false) AS min_price_lag_int,
  coalesce(CAST(trunc(ppu) AS BIGINT) % 10 = 9 AND ppu < 90, false) AS ppu_ldp FROM lagged"""


MARKET_MIN_SQL = {
    "sku_chain": _market_min_sql("PARTITION BY sku_gtin, kjedeid ORDER BY week"),
    "sku": _market_min_sql("PARTITION BY sku_gtin ORDER BY kjedeid, week"),
    # Stores in the role of products, each sold by one chain.
    "store": _market_min_sql("PARTITION BY sku_gtin ORDER BY kjedeid, week", "CAST(store_id AS BIGINT)"),
}


def _register_market_min(name, scope):
    @query(name, MARKET_MIN_SQL[scope])
    def market_min(spark, sf_dir):
        return rounded(market_min_response(cells_b(spark, sf_dir), scope), ["sales"])


_register_market_min("market_min_lag_chain", "sku_chain")
_register_market_min("market_min_lag_sku", "sku")

DYNAMIC_COLUMNS = ["sku_gtin", "store_id", "trans", "price", "quantity", "ppu"]
_MODE_PARTS = ", ".join(
    f"""m_{c} AS (SELECT week, kjedeid, {c} FROM (
  SELECT week, kjedeid, {c}, count(*) AS n FROM rows_of WHERE {c} IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY week, kjedeid ORDER BY n DESC, {c}) = 1)"""
    for c in DYNAMIC_COLUMNS
)


@query(
    "product_dynamics",
    f"""WITH {PRICE_CELLS_SQL}, rows_of AS (
  SELECT month, week, sku_gtin, store_id, kjedeid, trans, price, quantity, ppu FROM price_cells
  WHERE sku_gtin = 42 AND kjedeid IN ('chain_0', 'chain_1', 'chain_2')), {_MODE_PARTS}
SELECT week, kjedeid, sku_gtin, store_id, trans, {sql_r6("price")} AS price, quantity, ppu,
  CAST(trunc(ppu) AS BIGINT) % 10 = 9 AND ppu < 90 AS unit_nine,
  CAST(round_even(ppu * 100, 0) AS BIGINT) % 100 IN (90, 95, 99) AS cent_nine,
  (CAST(trunc(ppu) AS BIGINT) % 10 = 9 AND ppu < 90) OR CAST(round_even(ppu * 100, 0) AS BIGINT) % 100 IN (90, 95, 99) AS any_nine
FROM m_sku_gtin {" ".join(f"JOIN m_{c} USING (week, kjedeid)" for c in DYNAMIC_COLUMNS[1:])}""",
)
def product_dynamics_query(spark, sf_dir):
    cells = views.price_cells(spark, sf_dir)
    path = product_dynamics(cells, 42, ["chain_0", "chain_1", "chain_2"], DYNAMIC_COLUMNS)
    return rounded(path, ["price"])


@query(
    "discount_flag",
    f"""WITH {PRICE_CELLS_SQL}, counted AS (
  SELECT sku_gtin, week, kjedeid, ppu, count(*) AS n FROM price_cells WHERE ppu IS NOT NULL GROUP BY ALL),
usual AS (SELECT sku_gtin, week, kjedeid, ppu AS usual_price FROM counted
  QUALIFY row_number() OVER (PARTITION BY sku_gtin, week, kjedeid ORDER BY n DESC, ppu) = 1)
SELECT month, week, sku_gtin, store_id, kjedeid, ppu, usual_price, coalesce(price < usual_price, false) AS is_discount
FROM price_cells LEFT JOIN usual USING (sku_gtin, week, kjedeid)""",
)
def discount_flag(spark, sf_dir):
    table = discounts(views.price_cells(spark, sf_dir), IV_GROUP)
    return table.select(*CELL.split(", "), "kjedeid", "ppu", "usual_price", "is_discount")


@query(
    "demean_one_way",
    f"""WITH {CELLS_B_SQL}
SELECT {CELL}, kjedeid, ppu, {sql_r6("ln(quantity) - avg(ln(quantity)) OVER (PARTITION BY store_id)")} AS log_quantity_demeaned
FROM flagged""",
)
def demean_one_way(spark, sf_dir):
    cells = cells_b(spark, sf_dir).withColumn("log_quantity", F.ln("quantity"))
    table = demean(cells, ["log_quantity"], ["store_id"])
    return rounded(table, ["log_quantity_demeaned"]).select(
        *CELL.split(", "), "kjedeid", "ppu", "log_quantity_demeaned"
    )


@query(
    "demean_two_way",
    f"""WITH {CELLS_B_SQL}, a AS (
  SELECT *, ln(quantity) - avg(ln(quantity)) OVER (PARTITION BY store_id) AS q1,
         unit_nine - avg(unit_nine) OVER (PARTITION BY store_id) AS u1 FROM flagged),
b AS (SELECT *, q1 - avg(q1) OVER (PARTITION BY sku_gtin) AS q2, u1 - avg(u1) OVER (PARTITION BY sku_gtin) AS u2 FROM a)
SELECT {CELL}, kjedeid, ppu, {sql_r6("q2")} AS log_quantity_demeaned, {sql_r6("u2")} AS unit_nine_demeaned,
       {sql_r6("q2 * u2")} AS interaction FROM b""",
)
def demean_two_way(spark, sf_dir):
    cells = cells_b(spark, sf_dir).withColumns(
        {"log_quantity": F.ln("quantity"), "unit_nine": F.col("unit_nine").cast("double")}
    )
    table = demean_in_turn(cells, ["log_quantity", "unit_nine"], [["store_id"], ["sku_gtin"]])
    table = table.withColumn("interaction", F.col("log_quantity_demeaned") * F.col("unit_nine_demeaned"))
    values = ["log_quantity_demeaned", "unit_nine_demeaned", "interaction"]
    return rounded(table, values).select(*CELL.split(", "), "kjedeid", "ppu", *values)
