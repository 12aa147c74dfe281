"""The test tables in the roles of this library's inputs, for Spark and as SQL.

``scan_lines``  purchase lines from the order items: relational shape.
``price_obs``   dense purchase lines with cent prices from the event table.
``store_geo``   stores with coordinates from the supplier table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import week_of_year_sunday
from ..operators.clean import Feed

WINDOW = (dt.date(1998, 5, 31), dt.date(1998, 12, 1))
TERMS = ["ring", "rod"]
MAX_SALES = 200_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order items in the schema of a purchase feed."""
    items = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        F.col("l_shipdate").alias("date"),
        F.col("l_suppkey").alias("store_id"),
        F.col("l_partkey").alias("sku_gtin"),
        F.col("p_name").alias("sku_description"),
        F.col("l_extendedprice").alias("sales"),
        F.col("l_quantity").alias("quantity"),
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stores: chain is the nation, owner the region."""
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").cast("string").alias("id"),
            F.col("n_name").alias("kjedeid"),
            F.col("r_name").alias("paraplykjede"),
        )
    )


def chains(first: int = 0, last: int = 24) -> list[str]:
    return [f"NATION_{i}" for i in range(first, last + 1)]


def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned lines of one feed with every chain kept."""
    from ..operators.clean import clean_lines

    feed = Feed(raw_lines(spark, sf_dir), chains=chains())
    return clean_lines(
        [feed], stores(spark, sf_dir), window=WINDOW, max_sales=MAX_SALES, exclude_terms=TERMS
    )


SCAN_LINES_SQL = f"""
stores AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS id, n_name AS kjedeid, r_name AS paraplykjede
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
raw_lines AS (
  SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS store_id,
         l_partkey AS sku_gtin, p_name AS sku_description,
         l_extendedprice AS sales, l_quantity AS quantity
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
),
scan_lines AS (
  SELECT store_id, date, sku_gtin, sales, quantity, kjedeid, paraplykjede,
         CAST(month(date) AS INTEGER) AS month,
         CAST(strftime(date, '%U') AS INTEGER) AS week,
         sales / quantity AS ppu,
         CAST(floor(sales) AS BIGINT) % 10 AS kron,
         round(sales - floor(sales), 2) AS ore
  FROM raw_lines JOIN stores ON store_id = id
  WHERE sales > 0 AND sales <= {MAX_SALES}
    AND date > DATE '{WINDOW[0]}' AND date < DATE '{WINDOW[1]}'
    AND NOT regexp_matches(sku_description, '{TERMS[0]}', 'i')
    AND NOT regexp_matches(sku_description, '{TERMS[1]}', 'i')
)
"""


def price_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dense purchase lines with cent prices."""
    events = table(spark, sf_dir, "events")
    cents = F.element_at(
        F.array(*[F.lit(c) for c in (0.0, 0.5, 0.9, 0.95)]), (F.col("event_id") % 4 + 1).cast("int")
    )
    day = F.to_date("ts")
    base = events.select(
        "event_id",
        F.col("event_type").alias("feed"),
        F.col("user_id").cast("string").alias("store_id"),
        F.concat(F.lit("chain_"), (F.col("user_id") % 5).cast("string")).alias("kjedeid"),
        (F.col("user_id") % 7).alias("municipality"),
        F.get_json_object("props", "$.k").cast("long").alias("sku_gtin"),
        day.alias("date"),
        (F.floor("value") % 20 + cents).alias("ppu"),
        (F.col("event_id") % 5 + 1).cast("double").alias("quantity"),
    )
    return base.withColumns(
        {
            "sku_group": F.col("sku_gtin") % 10,
            "week": week_of_year_sunday(F.col("date")),
            "month": F.month("date"),
            "sales": F.round(F.col("ppu") * F.col("quantity"), 2),
        }
    )


PRICE_OBS_SQL = """
price_base AS (
  SELECT event_id, event_type AS feed, CAST(user_id AS VARCHAR) AS store_id,
         'chain_' || CAST(user_id % 5 AS VARCHAR) AS kjedeid, user_id % 7 AS municipality,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS sku_gtin,
         CAST(ts AS DATE) AS date,
         CAST(floor(value) AS BIGINT) % 20
           + CASE event_id % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE
                               WHEN 2 THEN 0.9::DOUBLE ELSE 0.95::DOUBLE END AS ppu,
         CAST(event_id % 5 + 1 AS DOUBLE) AS quantity
  FROM events
),
price_obs AS (
  SELECT *, sku_gtin % 10 AS sku_group, CAST(strftime(date, '%U') AS INTEGER) AS week,
         CAST(month(date) AS INTEGER) AS month, round(ppu * quantity, 2) AS sales
  FROM price_base
)
"""


def price_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of ``price_obs`` with their modal price."""
    from ..operators.cells import build_cells, build_modes, join_modes

    lines = price_obs(spark, sf_dir)
    return join_modes(build_cells(lines), build_modes(lines))


PRICE_CELLS_SQL = (
    PRICE_OBS_SQL
    + """,
cells AS (
  SELECT month, week, sku_gtin, store_id, kjedeid, count(*) AS trans, avg(ppu) AS price,
         sum(quantity) AS quantity
  FROM price_obs GROUP BY month, week, sku_gtin, store_id, kjedeid
),
points AS (
  SELECT month, week, sku_gtin, store_id, ppu, count(*) AS n
  FROM price_obs GROUP BY month, week, sku_gtin, store_id, ppu
),
modes AS (
  SELECT *, max(n) OVER (PARTITION BY month, week, sku_gtin, store_id) AS mode FROM points
  QUALIFY n = mode
),
price_cells AS (
  SELECT c.*, m.ppu FROM cells AS c LEFT JOIN modes AS m USING (month, week, sku_gtin, store_id)
)
"""
)


def store_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stores on a plane, with a second key and an address."""
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    s = F.col("s_suppkey")
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            s.alias("id"),
            F.concat(F.lit("70"), F.lpad(s.cast("string"), 6, "0")).alias("gln"),
            F.col("n_name").alias("kjedeid"),
            F.col("r_name").alias("paraplykjede"),
            F.concat(F.lit("street "), (s % 40).cast("string")).alias("adresse"),
            (s % 20).cast("string").alias("postnr"),
            (s % 10).cast("string").alias("poststed"),
            F.when(s % 9 != 0, (s % 7).cast("string")).alias("kommune_id"),
            F.col("s_acctbal").alias("oms"),
            ((s * s * 7919 + 13 * s) % 20011).cast("double").alias("x"),
            ((s * s * 6007 + 101 * s) % 20021).cast("double").alias("y"),
        )
    )


STORE_GEO_SQL = """
store_geo AS (
  SELECT s_suppkey AS id, '70' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS gln,
         n_name AS kjedeid, r_name AS paraplykjede,
         'street ' || CAST(s_suppkey % 40 AS VARCHAR) AS adresse,
         CAST(s_suppkey % 20 AS VARCHAR) AS postnr, CAST(s_suppkey % 10 AS VARCHAR) AS poststed,
         CASE WHEN s_suppkey % 9 <> 0 THEN CAST(s_suppkey % 7 AS VARCHAR) END AS kommune_id,
         s_acctbal AS oms,
         CAST((s_suppkey * s_suppkey * 7919 + 13 * s_suppkey) % 20011 AS DOUBLE) AS x,
         CAST((s_suppkey * s_suppkey * 6007 + 101 * s_suppkey) % 20021 AS DOUBLE) AS y
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)
"""
