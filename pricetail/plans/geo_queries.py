"""Local competition and matching of store tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digits_only, to_long_or_null, with_endings
from ..operators.cells import build_cells, build_modes, join_modes
from ..operators.clean import plausible
from ..operators.geo import (
    competitors_within,
    dedupe_addresses,
    local_monopoly,
    match_coverage,
    nearest_store,
    two_key_join,
    unmatched,
    with_municipality,
)
from ..operators.shares import store_profile
from . import views
from .registry import query, r6, rounded, sql_r6
from .views import SCAN_LINES_SQL, STORE_GEO_SQL

# Left-hand store keys: one in three is a business number, one in seven unknown.
LEFT_SQL = f"""{STORE_GEO_SQL},
left_stores AS (
  SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 6 THEN 900000 + s_suppkey
       WHEN s_suppkey % 3 = 1 THEN 70000000 + s_suppkey ELSE s_suppkey END AS store_id FROM supplier),
right_stores AS (
  SELECT *, TRY_CAST(regexp_replace(CAST(id AS VARCHAR), '[^0-9]', '', 'g') AS BIGINT) AS id_int FROM store_geo)"""


def left_stores(spark, sf_dir):
    s = F.col("s_suppkey")
    key = F.when(s % 7 == 6, s + 900000).when(s % 3 == 1, s + 70000000).otherwise(s)
    return views.table(spark, sf_dir, "supplier").select("s_suppkey", key.alias("store_id"))


@query(
    "two_key_join",
    f"""WITH {LEFT_SQL}
SELECT l.s_suppkey, l.store_id, coalesce(a.paraplykjede, b.paraplykjede) AS paraplykjede,
       coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y,
       CASE WHEN a.id IS NOT NULL THEN 'id_int' WHEN b.id IS NOT NULL THEN 'gln_clean' END AS matched_on
FROM left_stores AS l LEFT JOIN right_stores AS a ON l.store_id = a.id_int
LEFT JOIN right_stores AS b ON CAST(l.store_id AS VARCHAR) = b.gln""",
)
def two_key_join_query(spark, sf_dir):
    right = views.store_geo(spark, sf_dir)
    left = left_stores(spark, sf_dir)
    return two_key_join(
        left,
        right,
        F.col("store_id").cast("string"),
        to_long_or_null(digits_only(F.col("id"))).cast("string"),
        digits_only(F.col("gln")),
        ["paraplykjede", "x", "y"],
    )


@query(
    "geo_coverage",
    f"""WITH {LEFT_SQL}
SELECT count_if(kjedeid IS NULL)::BIGINT AS without_match, count_if(kjedeid IS NOT NULL)::BIGINT AS with_match
FROM left_stores LEFT JOIN right_stores ON store_id = id_int""",
)
def geo_coverage(spark, sf_dir):
    right = views.store_geo(spark, sf_dir)
    return match_coverage(left_stores(spark, sf_dir), right, "store_id", "id", "kjedeid")


@query(
    "geo_unmatched",
    f"WITH {LEFT_SQL} SELECT s_suppkey, store_id FROM left_stores ANTI JOIN right_stores ON store_id = id_int",
)
def geo_unmatched(spark, sf_dir):
    return unmatched(left_stores(spark, sf_dir), views.store_geo(spark, sf_dir), "store_id", "id")


@query(
    "store_extract",
    f"""WITH {STORE_GEO_SQL}, sold AS (
  SELECT l_suppkey AS store_id, count(*) AS trans, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_suppkey)
SELECT s.store_id, s.trans, s.quantity, g.kjedeid, g.paraplykjede, g.oms, g.x, g.y
FROM sold AS s LEFT JOIN store_geo AS g ON s.store_id = g.id""",
)
def store_extract(spark, sf_dir):
    """Store totals with the attributes and coordinates of the store table."""
    sold = (
        views.table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("store_id"))
        .agg(F.count(F.lit(1)).alias("trans"), F.sum("l_quantity").alias("quantity"))
    )
    places = views.store_geo(spark, sf_dir).select("id", "kjedeid", "paraplykjede", "oms", "x", "y").distinct()
    return sold.join(places.withColumnRenamed("id", "store_id"), "store_id", "left")


@query(
    "store_extract_endings",
    f"""WITH {SCAN_LINES_SQL}, {STORE_GEO_SQL},
cells AS (
  SELECT month, week, sku_gtin, store_id, kjedeid, count(*) AS trans, avg(ppu) AS price, sum(quantity) AS quantity FROM scan_lines GROUP BY ALL),
points AS (SELECT month, week, sku_gtin, store_id, ppu, count(*) AS n FROM scan_lines GROUP BY ALL),
modes AS (SELECT * FROM points QUALIFY n = max(n) OVER (PARTITION BY month, week, sku_gtin, store_id)),
flagged AS (
  SELECT store_id, trans, quantity,
         CAST(CAST(trunc(ppu) AS BIGINT) % 10 = 9 AND trunc(ppu) < 90 AS INTEGER) AS unit_nine,
         CAST(CAST(round_even(ppu * 100, 0) AS BIGINT) % 100 IN (90, 95, 99) AS INTEGER) AS cent_nine
  FROM cells JOIN modes USING (month, week, sku_gtin, store_id)
  WHERE price > 0 AND price < 1000 AND quantity > 0 AND quantity < 201),
sold AS (
  SELECT store_id, avg(greatest(unit_nine, cent_nine)) AS any_nine, avg(unit_nine) AS unit_nine, avg(cent_nine) AS cent_nine,
         CAST(sum(trans) AS BIGINT) AS trans, sum(quantity) AS quantity
  FROM flagged GROUP BY store_id),
geo AS (SELECT DISTINCT CAST(regexp_replace('ID-' || CAST(id AS VARCHAR), '[^0-9]', '', 'g') AS BIGINT) AS id_int,
  kjedeid, paraplykjede, oms, x, y FROM store_geo)
SELECT CAST(store_id AS BIGINT) AS store_id, {sql_r6("any_nine")} AS any_nine, {sql_r6("unit_nine")} AS unit_nine, {sql_r6("cent_nine")} AS cent_nine,
       trans, quantity, kjedeid, paraplykjede, oms, x, y FROM sold LEFT JOIN geo ON CAST(store_id AS BIGINT) = id_int""",
)
def store_extract_endings(spark, sf_dir):
    """One row per store: shares of modal prices by ending, totals of its cells, and its place where it is known."""
    lines = views.scan_lines(spark, sf_dir)
    cells = plausible(join_modes(build_cells(lines), build_modes(lines)), 1000)
    flags = ["any_nine", "unit_nine", "cent_nine"]
    # Stores are summed up before they meet the store table.
    sold = store_profile(with_endings(cells, "ppu", "C"), "store_id", flags, ["trans", "quantity"])
    places = views.store_geo(spark, sf_dir).select(
        to_long_or_null(digits_only(F.concat(F.lit("ID-"), F.col("id").cast("string")))).alias("store_id"),
        "kjedeid", "paraplykjede", "oms", "x", "y",
    ).distinct()
    sold = sold.withColumn("store_id", F.col("store_id").cast("long"))
    return rounded(sold.join(places, "store_id", "left"), flags)


@query(
    "municipality_default",
    f"""WITH {STORE_GEO_SQL}
SELECT coalesce(kommune_id, '0301') AS kommune_id, count(*) AS n
FROM lineitem LEFT JOIN (SELECT DISTINCT id, kommune_id FROM store_geo) ON l_suppkey = id GROUP BY ALL""",
)
def municipality_default(spark, sf_dir):
    items = views.table(spark, sf_dir, "lineitem").select("l_suppkey")
    placed = with_municipality(items, views.store_geo(spark, sf_dir), "l_suppkey", "id")
    return placed.groupBy("kommune_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dedupe_address",
    f"""WITH {STORE_GEO_SQL}
SELECT id, gln, kjedeid, adresse, postnr, poststed FROM store_geo
QUALIFY row_number() OVER (PARTITION BY adresse, postnr, poststed ORDER BY id) = 1""",
)
def dedupe_address(spark, sf_dir):
    kept = dedupe_addresses(views.store_geo(spark, sf_dir))
    return kept.select("id", "gln", "kjedeid", "adresse", "postnr", "poststed")


_DISTANCE = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


def _nearest_sql(condition):
    return f"""WITH {STORE_GEO_SQL}
SELECT a.id, {sql_r6(f"min({_DISTANCE})")} AS min_distance
FROM store_geo AS a LEFT JOIN store_geo AS b ON {condition} GROUP BY a.id"""


def _register_nearest(name, condition, **options):
    @query(name, _nearest_sql(condition))
    def nearest(spark, sf_dir):
        found = nearest_store(views.store_geo(spark, sf_dir), "id", "x", "y", **options)
        return found.select("id", r6("min_distance").alias("min_distance"))


_register_nearest("nearest_all", "a.id <> b.id")
_register_nearest("nearest_nonzero", "(a.x <> b.x OR a.y <> b.y)", exclude="zero")
_register_nearest("nearest_other_chain", "a.kjedeid <> b.kjedeid", differ_on="kjedeid")
_register_nearest("nearest_other_group", "a.paraplykjede <> b.paraplykjede", differ_on="paraplykjede")


@query(
    "competitors_within",
    f"""WITH {STORE_GEO_SQL}, pairs AS (
  SELECT a.id, {_DISTANCE} AS d FROM store_geo AS a JOIN store_geo AS b ON a.kjedeid <> b.kjedeid)
SELECT id, count_if(d <= 2000)::BIGINT AS competitors_within_2km, count_if(d <= 5000)::BIGINT AS competitors_within_5km,
       count_if(d <= 10000)::BIGINT AS competitors_within_10km FROM pairs GROUP BY id""",
)
def competitors_within_query(spark, sf_dir):
    counted = competitors_within(views.store_geo(spark, sf_dir), "id", "x", "y", "kjedeid")
    return counted.select("id", *[c for c in counted.columns if c.startswith("competitors")])


MONOPOLY_RADII = [0.5, 1, 2]


@query(
    "local_monopoly",
    f"""WITH {STORE_GEO_SQL}, near AS (
  SELECT a.id, a.kjedeid, min({_DISTANCE}) AS d FROM store_geo AS a JOIN store_geo AS b ON a.kjedeid <> b.kjedeid GROUP BY ALL)
SELECT id, kjedeid, {sql_r6("d")} AS min_distance, d > 500 AS "local_monopoly_0.5km", d > 1000 AS local_monopoly_1km,
       d > 2000 AS local_monopoly_2km FROM near""",
)
def local_monopoly_query(spark, sf_dir):
    near = nearest_store(views.store_geo(spark, sf_dir), "id", "x", "y", differ_on="kjedeid")
    flagged = local_monopoly(near, "min_distance", MONOPOLY_RADII)
    flags = [f"local_monopoly_{r:g}km" for r in MONOPOLY_RADII]
    return rounded(flagged.select("id", "kjedeid", "min_distance", *[F.col(f"`{f}`") for f in flags]), ["min_distance"])


@query(
    "store_distance_table",
    f"""WITH {STORE_GEO_SQL}, kept AS (
  SELECT * FROM store_geo QUALIFY row_number() OVER (PARTITION BY adresse, postnr, poststed ORDER BY id) = 1)
SELECT a.id, {sql_r6(f"min(CASE WHEN a.id <> b.id THEN {_DISTANCE} END)")} AS min_distance_all,
       {sql_r6(f"min(CASE WHEN a.paraplykjede <> b.paraplykjede THEN {_DISTANCE} END)")} AS min_distance_other_group,
       {sql_r6(f"min(CASE WHEN a.kjedeid <> b.kjedeid THEN {_DISTANCE} END)")} AS min_distance_other_chain
FROM kept AS a CROSS JOIN kept AS b GROUP BY a.id""",
)
def store_distance_table(spark, sf_dir):
    """The store table with its three distances, one store per address."""
    stores = dedupe_addresses(views.store_geo(spark, sf_dir))
    names = {
        "min_distance_all": None,
        "min_distance_other_group": "paraplykjede",
        "min_distance_other_chain": "kjedeid",
    }
    for name, column in names.items():
        stores = nearest_store(stores, "id", "x", "y", differ_on=column, name=name)
    return rounded(stores, list(names)).select("id", *names)


@query(
    "store_competition_table",
    f"""WITH {SCAN_LINES_SQL}, {STORE_GEO_SQL}, shares AS (
  SELECT store_id, avg(CAST(CAST(floor(ppu) AS BIGINT) % 10 = 9 AS INTEGER)) AS unit_nine,
         avg(CAST(round(ppu - floor(ppu), 2) >= 0.9 AS INTEGER)) AS cent_nine, count(*) AS n_lines
  FROM scan_lines GROUP BY store_id),
pairs AS (
  SELECT a.id, {_DISTANCE} AS d, a.id <> b.id AS other, a.paraplykjede <> b.paraplykjede AS other_group, a.kjedeid <> b.kjedeid AS rival
  FROM store_geo AS a JOIN store_geo AS b ON true),
near AS (
  SELECT id, min(d) FILTER (other) AS d1, min(d) FILTER (other_group) AS d2, min(d) FILTER (rival) AS d3,
         count(*) FILTER (rival AND d <= 2000) AS c2, count(*) FILTER (rival AND d <= 5000) AS c5, count(*) FILTER (rival AND d <= 10000) AS c10
  FROM pairs GROUP BY id)
SELECT g.id, g.kjedeid, g.paraplykjede, g.oms, n_lines, {sql_r6("unit_nine")} AS unit_nine, {sql_r6("cent_nine")} AS cent_nine,
       {sql_r6("d1")} AS min_distance_all, {sql_r6("d2")} AS min_distance_other_group, {sql_r6("d3")} AS min_distance_other_chain,
       c2 AS competitors_within_2km, c5 AS competitors_within_5km, c10 AS competitors_within_10km
FROM store_geo AS g JOIN near ON near.id = g.id LEFT JOIN shares ON store_id = CAST(g.id AS VARCHAR)""",
)
def store_competition_table(spark, sf_dir):
    """Each store's ending shares with its distances to others and its rivals nearby."""
    flagged = with_endings(views.scan_lines(spark, sf_dir), "ppu", "A")
    shares = flagged.groupBy("store_id").agg(
        F.avg(F.col("unit_nine").cast("int")).alias("unit_nine"),
        F.avg(F.col("cent_nine").cast("int")).alias("cent_nine"),
        F.count(F.lit(1)).alias("n_lines"),
    )
    stores = views.store_geo(spark, sf_dir).select("id", "kjedeid", "paraplykjede", "oms", "x", "y")
    table = competitors_within(stores, "id", "x", "y", "kjedeid")
    distances = {"min_distance_all": None, "min_distance_other_group": "paraplykjede", "min_distance_other_chain": "kjedeid"}
    for name, column in distances.items():
        table = nearest_store(table, "id", "x", "y", differ_on=column, name=name)
    joined = table.join(shares, F.col("id").cast("string") == F.col("store_id"), "left").drop("store_id", "x", "y")
    return rounded(joined, ["unit_nine", "cent_nine", *distances])
