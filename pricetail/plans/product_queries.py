"""Product sets and product-level tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.products import (
    all_nonzero,
    attach,
    counts_by_chain,
    distinct_counts,
    exact_sample,
    flag_members,
    hash_sample,
    keep_listed,
    keep_members,
    popularity,
    sold_in_all,
    top_k,
    varied_products,
)
from . import views
from .registry import query, rounded, sql_r6
from .share_queries import CELLS_B_SQL, FLAGS, cells_b
from .views import PRICE_CELLS_SQL, PRICE_OBS_SQL, SCAN_LINES_SQL

CHAIN_LABELS = [f"chain_{i}" for i in range(5)]


@query(
    "sold_in_all_pivot",
    f"""WITH {PRICE_OBS_SQL}, wide AS (
  SELECT sku_gtin, {", ".join(f"count(*) FILTER (kjedeid = '{c}') AS {c}" for c in CHAIN_LABELS)}
  FROM price_obs GROUP BY sku_gtin)
SELECT * FROM wide WHERE {" AND ".join(f"{c} <> 0" for c in CHAIN_LABELS)}""",
)
def sold_in_all_pivot(spark, sf_dir):
    wide = counts_by_chain(views.price_obs(spark, sf_dir), "sku_gtin", "kjedeid", CHAIN_LABELS)
    return all_nonzero(wide, CHAIN_LABELS)


@query(
    "sold_in_all_flag",
    f"""WITH {SCAN_LINES_SQL}, per_sku AS (
  SELECT sku_gtin, count(DISTINCT paraplykjede) AS k FROM scan_lines GROUP BY sku_gtin),
marked AS (SELECT l.*, CAST(k = (SELECT count(DISTINCT paraplykjede) FROM scan_lines) AS INTEGER) AS sold_in_all
  FROM scan_lines AS l JOIN per_sku USING (sku_gtin))
SELECT sold_in_all, count(*) AS n, count(DISTINCT sku_gtin) AS skus FROM marked GROUP BY ALL""",
)
def sold_in_all_flag(spark, sf_dir):
    lines = views.scan_lines(spark, sf_dir).select("sku_gtin", "paraplykjede")
    everywhere = sold_in_all(lines, "sku_gtin", "paraplykjede")
    # Lines are counted before the join, so that a best seller is one row in it.
    per_sku = lines.groupBy("sku_gtin").agg(F.count(F.lit(1)).alias("n"))
    flagged = flag_members(per_sku, everywhere, "sku_gtin", "sku_gtin", "sold_in_all")
    return flagged.groupBy("sold_in_all").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("skus"))


@query(
    "top_k_skus_semi",
    f"""WITH {SCAN_LINES_SQL}, best AS (
  SELECT sku_gtin FROM scan_lines GROUP BY sku_gtin ORDER BY sum(quantity) DESC, sku_gtin LIMIT 500)
SELECT store_id, count(*) AS n, sum(quantity) AS quantity FROM scan_lines
WHERE sku_gtin IN (SELECT sku_gtin FROM best) GROUP BY store_id""",
)
def top_k_skus_semi(spark, sf_dir):
    lines = views.scan_lines(spark, sf_dir)
    # One row per store and product goes on: a best seller has no more of them than there are stores.
    sold = lines.groupBy("store_id", "sku_gtin").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))
    kept = keep_members(sold, top_k(sold, "sku_gtin", "quantity", 500), "sku_gtin")
    return kept.groupBy("store_id").agg(F.sum("n").alias("n"), F.sum("quantity").alias("quantity"))


# An allow-list that holds some products twice.
ALLOW_SQL = """allow AS (
  SELECT p_partkey AS sku_gtin FROM part WHERE p_size <= 25
  UNION ALL SELECT p_partkey AS sku_gtin FROM part WHERE p_size <= 5)"""


@query(
    "allowlist_inner",
    f"""WITH {SCAN_LINES_SQL}, {ALLOW_SQL}
SELECT sku_gtin, count(*) AS n, sum(quantity) AS quantity FROM scan_lines JOIN allow USING (sku_gtin) GROUP BY sku_gtin""",
)
def allowlist_inner(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    sku = F.col("p_partkey").alias("sku_gtin")
    listed = part.where("p_size <= 25").select(sku).unionByName(part.where("p_size <= 5").select(sku))
    kept = keep_listed(views.scan_lines(spark, sf_dir), listed, "sku_gtin")
    return kept.groupBy("sku_gtin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity")
    )


@query(
    "multi_store_multi_week",
    f"""WITH {SCAN_LINES_SQL}, eligible AS (
  SELECT sku_gtin FROM scan_lines GROUP BY sku_gtin
  HAVING count(DISTINCT store_id) > 1 AND count(DISTINCT week) > 1)
SELECT sku_gtin, count(*) AS n FROM scan_lines SEMI JOIN eligible USING (sku_gtin) GROUP BY sku_gtin""",
)
def multi_store_multi_week(spark, sf_dir):
    lines = views.scan_lines(spark, sf_dir).select("sku_gtin", "store_id", "week")
    kept = keep_members(lines, varied_products(lines, "sku_gtin", ["store_id", "week"]), "sku_gtin")
    return kept.groupBy("sku_gtin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "distinct_counts",
    f"""WITH {PRICE_OBS_SQL}
SELECT sku_gtin, count(DISTINCT store_id) AS n_store_id, count(DISTINCT week) AS n_week FROM price_obs GROUP BY sku_gtin""",
)
def distinct_counts_query(spark, sf_dir):
    return distinct_counts(views.price_obs(spark, sf_dir), "sku_gtin", ["store_id", "week"])


SUMS = {"trans": "total_transactions", "quantity": "total_quantity", "sales": "total_sales"}


@query(
    "popularity_share",
    f"""WITH {CELLS_B_SQL}, totals AS (
  SELECT sku_gtin, CAST(sum(trans) AS BIGINT) AS total_transactions, sum(quantity) AS total_quantity,
         {sql_r6("sum(sales)")} AS total_sales FROM flagged GROUP BY sku_gtin),
shares AS (
  SELECT sku_gtin, kjedeid, {sql_r6("avg(unit_nine)")} AS unit_nine, {sql_r6("avg(cent_nine)")} AS cent_nine
  FROM flagged GROUP BY sku_gtin, kjedeid)
SELECT * FROM shares JOIN totals USING (sku_gtin)""",
)
def popularity_share(spark, sf_dir):
    table = popularity(cells_b(spark, sf_dir), "sku_gtin", "kjedeid", FLAGS, SUMS)
    ordered = table.orderBy(F.desc("total_transactions"), "sku_gtin", "kjedeid")
    return rounded(ordered, [*FLAGS, "total_sales"])


@query(
    "hash_sample",
    f"""WITH {SCAN_LINES_SQL}, keyed AS (SELECT *, CAST(round(sales * 100) AS BIGINT) AS cents FROM scan_lines)
SELECT store_id, sku_gtin, date, cents FROM keyed
WHERE CAST('0x' || substr(md5(concat_ws('|', '42', store_id::VARCHAR, sku_gtin::VARCHAR, date::VARCHAR, cents::VARCHAR)), 1, 8) AS BIGINT)
      % 1000000 < 100000""",
)
def hash_sample_query(spark, sf_dir):
    """A tenth of the lines; sales enter the hash as whole cents."""
    lines = views.scan_lines(spark, sf_dir).withColumn("cents", F.round(F.col("sales") * 100).cast("long"))
    keys = ["store_id", "sku_gtin", "date", "cents"]
    return hash_sample(lines, keys, 0.1).select(*keys)


@query(
    "exact_sample",
    f"""WITH {SCAN_LINES_SQL}, keyed AS (SELECT *, CAST(round(sales * 100) AS BIGINT) AS cents FROM scan_lines)
SELECT store_id, sku_gtin, date, cents FROM keyed
ORDER BY md5(concat_ws('|', '42', store_id::VARCHAR, sku_gtin::VARCHAR, date::VARCHAR, cents::VARCHAR))
LIMIT (SELECT CAST(round_even(0.1::DOUBLE * count(*), 0) AS BIGINT) FROM keyed)""",
)
def exact_sample_query(spark, sf_dir):
    """A tenth of the lines, to the row; sales enter the hash as whole cents."""
    lines = views.scan_lines(spark, sf_dir).withColumn("cents", F.round(F.col("sales") * 100).cast("long"))
    keys = ["store_id", "sku_gtin", "date", "cents"]
    return exact_sample(lines, keys, 0.1).select(*keys)


@query(
    "product_join",
    f"""WITH {SCAN_LINES_SQL}, cells AS (
  SELECT month, week, sku_gtin, store_id, kjedeid, count(*) AS trans FROM scan_lines WHERE month = 6 GROUP BY ALL)
SELECT p_brand AS brand, p_type AS category, count(*) AS cells, CAST(sum(trans) AS BIGINT) AS trans
FROM cells LEFT JOIN part ON sku_gtin = p_partkey GROUP BY ALL""",
)
def product_join(spark, sf_dir):
    """One month of cells with the attributes of the product table."""
    from ..operators.cells import build_cells

    cells = build_cells(views.scan_lines(spark, sf_dir).where(F.col("month") == 6))
    products = views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("GTIN"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
    )
    joined = attach(cells, products, "sku_gtin", "GTIN")
    return joined.groupBy("brand", "category").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("trans").alias("trans")
    )


@query(
    "category_join",
    f"""WITH {PRICE_CELLS_SQL}, categories AS (
  SELECT DISTINCT p_partkey AS sku, p_type AS kassalcat FROM part WHERE p_partkey % 10 <> 3),
kept AS (SELECT *, floor(ppu) AS fl FROM price_cells LEFT JOIN categories ON sku_gtin = sku)
SELECT kassalcat, fl AS floor, floor(fl / 10) * 10 AS "group", count(*) AS n FROM kept
WHERE fl <= 100 AND kassalcat IS NOT NULL GROUP BY ALL""",
)
def category_join(spark, sf_dir):
    """Price bins of cells whose product has a known category."""
    categories = (
        views.table(spark, sf_dir, "part")
        .where(F.col("p_partkey") % 10 != 3)
        .select(F.col("p_partkey").alias("sku"), F.col("p_type").alias("kassalcat"))
    )
    floor = F.floor("ppu").cast("double")
    binned = attach(views.price_cells(spark, sf_dir), categories, "sku_gtin", "sku").withColumn("floor", floor)
    kept = binned.where((F.col("floor") <= 100) & F.col("kassalcat").isNotNull())
    group = (F.floor(F.col("floor") / 10) * 10).cast("double").alias("group")
    return kept.groupBy("kassalcat", "floor", group).agg(F.count(F.lit(1)).alias("n"))


@query(
    "attribute_flag",
    f"""WITH {PRICE_OBS_SQL}, known AS (SELECT DISTINCT p_partkey AS ean FROM part WHERE p_size > 20)
SELECT CAST(ean IS NOT NULL AS INTEGER) AS has_attributes, count(*) AS n
FROM price_obs LEFT JOIN known ON sku_gtin = ean GROUP BY ALL""",
)
def attribute_flag(spark, sf_dir):
    known = views.table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").alias("ean"))
    flagged = flag_members(views.price_obs(spark, sf_dir), known, "sku_gtin", "ean", "has_attributes")
    return flagged.groupBy("has_attributes").agg(F.count(F.lit(1)).alias("n"))
