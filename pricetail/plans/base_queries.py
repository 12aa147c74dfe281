"""Sources, cleaning, price endings, cells and modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (
    chain_format,
    chain_owner,
    digits_only,
    ends_cent_nine,
    ends_unit_nine,
    owner_group_label,
    to_long_or_null,
    unit_price,
    week_of_year_sunday,
)
from ..functions.scalars import decade
from ..operators.cells import CELL_KEY, build_cells, build_modes, join_modes, price_points
from ..operators.clean import (
    Feed,
    clean_lines,
    finite_prices,
    null_tally,
    plausible,
    standard_codes,
    within_window,
    without_terms,
)
from ..operators.geo import nearest_store
from ..operators.groups import first_by, group_mode
from ..schemas import CELLS, MODES, STORES_WITH_DISTANCE
from ..session import scratch_path
from ..sources import (
    read_csv_table,
    read_months,
    read_parquet_tree,
    replace_months,
    write_bucketed,
    write_csv_table,
    write_months,
)
from . import views
from .registry import query, r6, rounded, sql_r6
from .views import PRICE_CELLS_SQL, PRICE_OBS_SQL, SCAN_LINES_SQL, STORE_GEO_SQL

LISTED = views.chains(0, 19)
FIXED = "THIRD"

CLEAN_UNION_SQL = f"""
stores AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS id, n_name AS kjedeid, r_name AS paraplykjede
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
feed_lines AS (
  SELECT l_suppkey % 3 AS feed, CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS store_id,
         l_partkey AS sku_gtin, p_name AS sku_description, l_extendedprice AS sales, l_quantity AS quantity
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
),
kept AS (
  SELECT * FROM feed_lines
  WHERE sales > 0 AND sales <= {views.MAX_SALES}
    AND date > DATE '{views.WINDOW[0]}' AND date < DATE '{views.WINDOW[1]}'
    AND NOT regexp_matches(sku_description, '{views.TERMS[0]}', 'i')
    AND NOT regexp_matches(sku_description, '{views.TERMS[1]}', 'i')
),
clean_union AS (
  SELECT store_id, date, sku_gtin, sales, quantity, kjedeid, paraplykjede
  FROM kept JOIN stores ON store_id = id
  WHERE feed IN (0, 1) AND kjedeid IN ({", ".join(f"'{c}'" for c in LISTED)})
  UNION ALL
  SELECT store_id, date, sku_gtin, sales, quantity, '{FIXED}' AS kjedeid, paraplykjede
  FROM kept LEFT JOIN stores ON store_id = id WHERE feed = 2 AND sku_gtin IS NOT NULL
)
"""


def clean_union_lines(spark, sf_dir):
    """Three feeds with their own store keys; the third carries one fixed chain."""
    raw = views.raw_lines(spark, sf_dir)
    part = F.col("store_id") % 3
    feeds = [
        Feed(raw.where(part == 0), chains=LISTED),
        Feed(raw.where(part == 1), chains=LISTED),
        Feed(
            raw.where(part == 2).withColumnRenamed("store_id", "business_gln"),
            store_key="business_gln",
            fixed_chain=FIXED,
            require_sku=True,
        ),
    ]
    return clean_lines(
        feeds,
        views.stores(spark, sf_dir),
        window=views.WINDOW,
        max_sales=views.MAX_SALES,
        exclude_terms=views.TERMS,
    )


@query(
    "clean_union",
    f"""WITH {CLEAN_UNION_SQL}
SELECT store_id, date, sku_gtin, sales, quantity, kjedeid, paraplykjede,
       CAST(month(date) AS INTEGER) AS month, CAST(strftime(date, '%U') AS INTEGER) AS week,
       {sql_r6("sales / quantity")} AS ppu, CAST(floor(sales) AS BIGINT) % 10 AS kron,
       {sql_r6("round(sales - floor(sales), 2)")} AS ore
FROM clean_union""",
)
def clean_union(spark, sf_dir):
    return rounded(clean_union_lines(spark, sf_dir), ["ppu", "ore"])


@query(
    "window_and_term_filter",
    f"""SELECT count(*) AS n, count(DISTINCT l_suppkey) AS stores FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_shipdate >= DATE '1998-06-01' AND l_shipdate < DATE '1998-12-01'
  AND NOT regexp_matches(p_name, '{views.TERMS[0]}', 'i') AND NOT regexp_matches(p_name, '{views.TERMS[1]}', 'i')""",
)
def window_and_term_filter(spark, sf_dir):
    raw = views.raw_lines(spark, sf_dir)
    kept = raw.where(within_window("date", views.WINDOW) & without_terms("sku_description", views.TERMS))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("store_id").alias("stores"))


@query(
    "week_u",
    """SELECT d AS date, CAST(month(d) AS INTEGER) AS month, CAST(strftime(d, '%U') AS INTEGER) AS week, count(*) AS n
FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem) GROUP BY d""",
)
def week_u(spark, sf_dir):
    days = views.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    counted = days.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "date",
        F.month("date").alias("month"),
        week_of_year_sunday(F.col("date")).alias("week"),
        "n",
    )


@query(
    "month_counts",
    f"""WITH {SCAN_LINES_SQL}
SELECT month, count(*) AS n FROM scan_lines WHERE month IN (6, 9, 11) GROUP BY month""",
)
def month_counts(spark, sf_dir):
    lines = views.scan_lines(spark, sf_dir).where(F.col("month").isin(6, 9, 11))
    return lines.groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query(
    "month_week_straddle",
    f"""WITH {SCAN_LINES_SQL}
SELECT week, count(DISTINCT month) AS months, count(*) AS n FROM scan_lines GROUP BY week HAVING count(DISTINCT month) > 1""",
)
def month_week_straddle(spark, sf_dir):
    """Weeks whose lines fall in two months, which therefore yield two sets of cells."""
    per = views.scan_lines(spark, sf_dir).groupBy("week", "month").agg(F.count(F.lit(1)).alias("n"))
    weeks = per.groupBy("week").agg(F.count(F.lit(1)).alias("months"), F.sum("n").alias("n"))
    return weeks.where(F.col("months") > 1)


# Both price columns of the test tables, so that cents and large prices occur.
ALL_PRICES_SQL = f"""{PRICE_OBS_SQL},
all_prices AS (
  SELECT ppu AS price FROM price_obs UNION ALL SELECT l_extendedprice AS price FROM lineitem
  UNION ALL SELECT p_retailprice AS price FROM part
)"""


def all_prices(spark, sf_dir):
    events = views.price_obs(spark, sf_dir).select(F.col("ppu").alias("price"))
    lines = views.table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("price"))
    parts = views.table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("price"))
    return events.unionByName(lines).unionByName(parts)


_CENTS = "CAST(round_even(price * 100, 0) AS BIGINT) % 100 IN (90, 95, 99)"
_WHOLE = "CAST(trunc(price) AS BIGINT)"
ENDING_TESTS = {
    "A": ("CAST(floor(price) AS BIGINT) % 10 = 9", "round(price - floor(price), 2) >= 0.9"),
    "B": (f"{_WHOLE} % 10 = 9 AND {_WHOLE} < 90", _CENTS),
    "C": (f"coalesce({_WHOLE} % 10 = 9 AND {_WHOLE} < 90, false)", f"coalesce({_CENTS}, false)"),
    "D": (
        "regexp_matches(split_part(CAST(price AS VARCHAR), '.', 1), '[0-9]*9$')",
        "regexp_matches(split_part(CAST(price AS VARCHAR), '.', 2), '9$|90$|95$')",
    ),
}


def _register_endings(kind):
    unit, cent = ENDING_TESTS[kind]

    @query(
        f"endings_{kind.lower()}",
        f"""WITH {ALL_PRICES_SQL}, flagged AS (
  SELECT price, {unit} AS unit_nine, {cent} AS cent_nine FROM all_prices)
SELECT floor(price / 10) * 10 AS decade, unit_nine, cent_nine, unit_nine OR cent_nine AS any_nine,
       count(*) AS n FROM flagged GROUP BY ALL""",
    )
    def endings(spark, sf_dir):
        price = F.col("price")
        flagged = all_prices(spark, sf_dir).select(
            decade(price).cast("double").alias("decade"),
            ends_unit_nine(price, kind).alias("unit_nine"),
            ends_cent_nine(price, kind).alias("cent_nine"),
        )
        return (
            flagged.groupBy("decade", "unit_nine", "cent_nine")
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("any_nine", F.col("unit_nine") | F.col("cent_nine"))
        )


for _kind in ENDING_TESTS:
    _register_endings(_kind)


@query(
    "unit_price_zero_quantity",
    """SELECT event_id % 5 AS quantity, count(*) AS n, count_if(isinf(p))::BIGINT AS infinite,
       round(sum(CASE WHEN isinf(p) THEN 0 ELSE p END), 2) AS finite_sum
FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN
        CASE WHEN value > 0 THEN 'inf'::DOUBLE WHEN value < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END
      ELSE value / (event_id % 5) END AS p FROM events) GROUP BY ALL""",
)
def unit_price_zero_quantity(spark, sf_dir):
    q = F.col("event_id") % 5
    priced = views.table(spark, sf_dir, "events").select(
        q.alias("quantity"), unit_price(F.col("value"), q).alias("p")
    )
    infinite = F.abs(F.col("p")) == float("inf")
    return priced.groupBy("quantity").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(infinite).alias("infinite"),
        F.round(F.sum(F.when(infinite, 0.0).otherwise(F.col("p"))), 2).alias("finite_sum"),
    )


@query(
    "gtin_length_filter",
    """SELECT length(CAST(code AS VARCHAR)) AS digits, count(*) AS n
FROM (SELECT l_partkey * 10007 + 12345 AS code FROM lineitem) WHERE length(CAST(code AS VARCHAR)) IN (6, 8) GROUP BY ALL""",
)
def gtin_length_filter(spark, sf_dir):
    """Codes derived from the part key, kept by their number of digits."""
    items = views.table(spark, sf_dir, "lineitem")
    coded = items.select((F.col("l_partkey") * 10007 + 12345).alias("code"))
    kept = standard_codes(coded, "code", [6, 8])
    digits = F.length(F.col("code").cast("string")).cast("long").alias("digits")
    return kept.groupBy(digits).agg(F.count(F.lit(1)).alias("n"))


@query(
    "null_tally",
    f"""WITH {STORE_GEO_SQL}, lined AS (
  SELECT l_orderkey, kommune_id FROM lineitem LEFT JOIN store_geo ON l_suppkey = id)
SELECT kommune_id IS NULL AS missing, count(*) AS n FROM lined GROUP BY ALL""",
)
def null_tally_query(spark, sf_dir):
    items = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"))
    towns = views.store_geo(spark, sf_dir).select("id", "kommune_id")
    return null_tally(items.join(towns, "id", "left"), "kommune_id")


# Nations in the roles of the named chains, in the order of the format lists.
ROLE_CHAINS = ["Rema", "kiwi", "meny", "spar", "nærbutikken", "joker", "Extra", "Marked", "Matkroken", "Mega", "Obs", "Prix", "other"]


@query(
    "chain_format_case",
    f"""SELECT chain, CASE WHEN chain = 'Rema' THEN 'Rema'
         WHEN chain IN ('kiwi', 'meny', 'spar', 'nærbutikken', 'joker') THEN 'NG'
         WHEN chain IN ('Extra', 'Marked', 'Matkroken', 'Mega', 'Obs', 'Prix') THEN 'Coop' END AS owner,
       CASE owner WHEN 'Coop' THEN 'Group 1' WHEN 'NG' THEN 'Group 2' WHEN 'Rema' THEN 'Group 3' END AS owner_lab,
       CASE WHEN chain IN ('Extra', 'Prix', 'kiwi', 'Rema') THEN 'discounter'
         WHEN chain IN ('meny', 'spar', 'Mega') THEN 'supermarket' WHEN chain = 'Obs' THEN 'hypermarket'
         WHEN chain IN ('joker', 'Marked', 'Matkroken', 'nærbutikken') THEN 'convenience' END AS format,
       replace(coalesce(format, 'none'), 'discounter', 'discount') AS format_short, count(*) AS n
FROM (SELECT list_extract([{", ".join(f"'{c}'" for c in ROLE_CHAINS)}], CAST(s_nationkey % 13 + 1 AS INTEGER)) AS chain
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY ALL""",
)
def chain_format_case(spark, sf_dir):
    names = F.array(*[F.lit(c) for c in ROLE_CHAINS])
    supplier = views.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"),
        F.element_at(names, (F.col("s_nationkey") % 13 + 1).cast("int")).alias("chain"),
    )
    chained = views.table(spark, sf_dir, "lineitem").select("l_suppkey").join(supplier, "l_suppkey")
    chain = F.col("chain")
    short = F.coalesce(chain_format(chain, "discount"), F.lit("none"))
    return (
        chained.groupBy("chain")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"owner": chain_owner(chain), "format": chain_format(chain), "format_short": short})
        .withColumn("owner_lab", owner_group_label(F.col("owner")))
    )


@query(
    "key_normalisation",
    """SELECT s_name, regexp_replace(s_name, '[^0-9]', '', 'g') AS digits,
       TRY_CAST(regexp_replace(s_name, '[^0-9]', '', 'g') AS BIGINT) AS number,
       TRY_CAST(s_name AS BIGINT) AS not_a_number FROM supplier""",
)
def key_normalisation(spark, sf_dir):
    name = F.col("s_name")
    return views.table(spark, sf_dir, "supplier").select(
        "s_name",
        digits_only(name).alias("digits"),
        to_long_or_null(digits_only(name)).alias("number"),
        to_long_or_null(name).alias("not_a_number"),
    )


@query(
    "plausible_prices",
    f"""WITH {PRICE_CELLS_SQL}
SELECT kjedeid, count_if(price > 0 AND price < 100 AND quantity > 0 AND quantity < 201)::BIGINT AS wide,
       count_if(price > 0 AND ppu < 15 AND quantity > 0 AND quantity < 8)::BIGINT AS narrow, count(*) AS n
FROM price_cells GROUP BY kjedeid""",
)
def plausible_prices(spark, sf_dir):
    """Rows kept by two sets of plausibility caps, per chain."""
    cells = views.price_cells(spark, sf_dir)
    wide = plausible(cells).groupBy("kjedeid").agg(F.count(F.lit(1)).alias("wide"))
    narrow = plausible(cells, 15, 8, "ppu").groupBy("kjedeid").agg(F.count(F.lit(1)).alias("narrow"))
    n = cells.groupBy("kjedeid").agg(F.count(F.lit(1)).alias("n"))
    return n.join(wide, "kjedeid").join(narrow, "kjedeid")


@query(
    "finite_prices",
    """SELECT user_id, count(*) AS n FROM events WHERE event_id % 5 <> 0 AND user_id IS NOT NULL GROUP BY user_id""",
)
def finite_price_filter(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    priced = events.withColumn("price", unit_price(F.col("value"), F.col("event_id") % 5))
    kept = finite_prices(priced, "price", "user_id")
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cells",
    f"""WITH {PRICE_CELLS_SQL}
SELECT month, week, sku_gtin, store_id, kjedeid, trans, {sql_r6("price")} AS price, quantity FROM cells""",
)
def cells(spark, sf_dir):
    return rounded(build_cells(views.price_obs(spark, sf_dir)), ["price"])


@query(
    "cells_from_lines",
    f"""WITH {SCAN_LINES_SQL}
SELECT month, week, sku_gtin, store_id, kjedeid, count(*) AS trans, {sql_r6("avg(ppu)")} AS price,
       sum(quantity) AS quantity FROM scan_lines GROUP BY month, week, sku_gtin, store_id, kjedeid""",
)
def cells_from_lines(spark, sf_dir):
    return rounded(build_cells(views.scan_lines(spark, sf_dir)), ["price"])


@query(
    "modes_ties",
    f"""WITH {PRICE_CELLS_SQL}
SELECT month, week, sku_gtin, store_id, ppu, n, mode FROM modes""",
)
def modes_ties(spark, sf_dir):
    return build_modes(views.price_obs(spark, sf_dir))


@query(
    "modes_by_chain_week",
    f"""WITH {PRICE_OBS_SQL}, counted AS (
  SELECT kjedeid, sku_group, week, ppu, count(*) AS n FROM price_obs GROUP BY ALL)
SELECT *, max(n) OVER (PARTITION BY kjedeid, sku_group, week) AS mode FROM counted QUALIFY n = mode""",
)
def modes_by_chain_week(spark, sf_dir):
    return build_modes(views.price_obs(spark, sf_dir), ["kjedeid", "sku_group", "week"])


@query(
    "cells_with_modes",
    f"""WITH {PRICE_CELLS_SQL}
SELECT month, week, sku_gtin, store_id, kjedeid, trans, {sql_r6("price")} AS price, quantity, ppu
FROM price_cells""",
)
def cells_with_modes(spark, sf_dir):
    lines = views.price_obs(spark, sf_dir)
    return rounded(join_modes(build_cells(lines), build_modes(lines)), ["price"])


@query(
    "single_mode",
    f"""WITH {PRICE_OBS_SQL}, counted AS (
  SELECT kjedeid, sku_gtin, week, ppu, count(*) AS n, sum(quantity) AS q FROM price_obs GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY kjedeid, sku_gtin, week ORDER BY n DESC, ppu) AS rn,
           sum(q) OVER (PARTITION BY kjedeid, sku_gtin, week) AS quantity FROM counted)
SELECT kjedeid, sku_gtin, week, ppu, quantity FROM ranked WHERE rn = 1""",
)
def single_mode(spark, sf_dir):
    lines = views.price_obs(spark, sf_dir)
    return group_mode(lines, ["kjedeid", "sku_gtin", "week"], "ppu", ["quantity"])


@query(
    "price_points",
    f"""WITH {PRICE_OBS_SQL}
SELECT store_id, week, kjedeid, ppu, count(*) AS n FROM price_obs GROUP BY ALL""",
)
def price_points_query(spark, sf_dir):
    return price_points(views.price_obs(spark, sf_dir), ["store_id", "week", "kjedeid"])


@query(
    "month_sink_roundtrip",
    f"""WITH {SCAN_LINES_SQL}
SELECT month, count(*) AS cells, sum(quantity) AS quantity, sum(trans)::BIGINT AS trans FROM (
  SELECT month, week, sku_gtin, store_id, kjedeid, count(*) AS trans, sum(quantity) AS quantity
  FROM scan_lines GROUP BY ALL) WHERE month IN (6, 7) GROUP BY month""",
)
def month_sink_roundtrip(spark, sf_dir):
    """Cells written by month and read back with month pruning and a declared schema."""
    path = scratch_path(spark, "cells")
    write_months(build_cells(views.scan_lines(spark, sf_dir)), path)
    back = read_months(spark, path, [6, 7], CELLS)
    return back.groupBy("month").agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum("quantity").alias("quantity"),
        F.sum("trans").alias("trans"),
    )


@query(
    "months_reloaded",
    f"""WITH {SCAN_LINES_SQL}
SELECT month, week, sku_gtin, store_id, kjedeid, count(*) AS trans, {sql_r6("avg(ppu)")} AS price, sum(quantity) AS quantity
FROM scan_lines GROUP BY ALL""",
)
def months_reloaded(spark, sf_dir):
    """A first load with faulty lines in one month and no lines of the last; both months loaded again, the others left."""
    path = scratch_path(spark, "cells")
    lines = views.scan_lines(spark, sf_dir)
    faulty = lines.where(F.col("month") < 11).withColumn(
        "quantity", F.when(F.col("month") == 8, F.col("quantity") * 10).otherwise(F.col("quantity"))
    )
    write_months(build_cells(faulty), path)
    replace_months(build_cells(lines.where(F.col("month").isin(8, 11))), path)
    return rounded(read_months(spark, path, schema=CELLS), ["price"])


@query(
    "cells_with_modes_bucketed",
    f"""WITH {PRICE_CELLS_SQL}
SELECT month, week, sku_gtin, store_id, kjedeid, trans, {sql_r6("price")} AS price, quantity, ppu FROM price_cells""",
)
def cells_with_modes_bucketed(spark, sf_dir):
    """Cells and modes written in the same buckets of their key, then joined where they lie."""
    lines = views.price_obs(spark, sf_dir)
    cells = write_bucketed(build_cells(lines), scratch_path(spark, "cells"), CELL_KEY)
    modes = write_bucketed(build_modes(lines), scratch_path(spark, "modes"), CELL_KEY)
    return rounded(join_modes(cells, modes.hint("merge")), ["price"])


@query(
    "modes_by_month",
    f"""WITH {PRICE_CELLS_SQL}
SELECT month, week, sku_gtin, store_id, ppu, n::BIGINT AS n, mode::BIGINT AS mode FROM modes""",
)
def modes_by_month(spark, sf_dir):
    """Modal prices written by month and read back with their declared schema."""
    path = scratch_path(spark, "modes")
    write_months(build_modes(views.price_obs(spark, sf_dir)), path)
    return read_months(spark, path, list(range(1, 13)), MODES)


@query(
    "parquet_tree_scan",
    """SELECT count(*) AS n, round(sum(quantity), 2) AS quantity FROM (
  SELECT CAST(event_id % 5 + 1 AS DOUBLE) AS quantity FROM events)""",
)
def parquet_tree_scan(spark, sf_dir):
    """Files spread over nested folders, read as one relation."""
    path = scratch_path(spark, "feed")
    lines = views.price_obs(spark, sf_dir).select("feed", "kjedeid", "quantity")
    lines.write.mode("overwrite").partitionBy("feed", "kjedeid").parquet(path)
    tree = read_parquet_tree(spark, path)
    return tree.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("quantity"), 2).alias("quantity"))


DISTANCES = {
    "min_distance_all": None,
    "min_distance_other_group": "paraplykjede",
    "min_distance_other_chain": "kjedeid",
}


@query(
    "csv_sink_roundtrip",
    f"""WITH {STORE_GEO_SQL}, pairs AS (
  SELECT a.id, a.id <> b.id AS other, a.paraplykjede <> b.paraplykjede AS other_group, a.kjedeid <> b.kjedeid AS other_chain,
         sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
  FROM store_geo AS a JOIN store_geo AS b ON true),
near AS (
  SELECT id, min(d) FILTER (other) AS d1, min(d) FILTER (other_group) AS d2, min(d) FILTER (other_chain) AS d3 FROM pairs GROUP BY id)
SELECT CAST(s.id AS VARCHAR) AS id, gln, kjedeid, paraplykjede, adresse, postnr, poststed, kommune_id, oms, x, y,
       {sql_r6("d1")} AS min_distance_all, {sql_r6("d2")} AS min_distance_other_group, {sql_r6("d3")} AS min_distance_other_chain
FROM store_geo AS s JOIN near USING (id)""",
)
def csv_sink_roundtrip(spark, sf_dir):
    """The store table with its distances through a delimited file, read back with its schema."""
    path = scratch_path(spark, "stores")
    stores = views.store_geo(spark, sf_dir)
    for name, column in DISTANCES.items():
        stores = nearest_store(stores, "id", "x", "y", differ_on=column, name=name)
    write_csv_table(rounded(stores, list(DISTANCES)), path, sep=";")
    return read_csv_table(spark, path, STORES_WITH_DISTANCE, sep=";")


@query(
    "distinct_stores",
    f"""WITH {SCAN_LINES_SQL}
SELECT DISTINCT store_id, kjedeid, paraplykjede FROM scan_lines""",
)
def distinct_stores(spark, sf_dir):
    return views.scan_lines(spark, sf_dir).select("store_id", "kjedeid", "paraplykjede").distinct()


@query(
    "first_line_per_product",
    f"""WITH {SCAN_LINES_SQL}
SELECT sku_gtin, date, store_id, sales, quantity FROM scan_lines
QUALIFY row_number() OVER (PARTITION BY sku_gtin ORDER BY date, store_id, sales, quantity) = 1""",
)
def first_line_per_product(spark, sf_dir):
    lines = views.scan_lines(spark, sf_dir).select("sku_gtin", "date", "store_id", "sales", "quantity")
    return first_by(lines, ["sku_gtin"], ["date", "store_id", "sales"])


@query(
    "rounding_rules",
    f"""WITH {ALL_PRICES_SQL}
SELECT price, {sql_r6("(cents + 4) // 8 / 100.0::DOUBLE")} AS half_up,
       {sql_r6("(5 * cents // 4 + CASE WHEN 5 * cents % 4 + (5 * cents // 4) % 2 > 2 THEN 1 ELSE 0 END) / 1000.0::DOUBLE")} AS half_even,
       floor(price) AS whole, floor(price / 10) * 10 AS decade, count(*) AS n
FROM (SELECT price, CAST(round(price * 100) AS BIGINT) AS cents FROM all_prices) GROUP BY price, cents""",
)
def rounding_rules(spark, sf_dir):
    counted = all_prices(spark, sf_dir).groupBy("price").agg(F.count(F.lit(1)).alias("n"))
    eighth = F.col("price") / 8
    return counted.select(
        "price",
        r6(F.round(eighth, 2)).alias("half_up"),
        r6(F.bround(eighth, 3)).alias("half_even"),
        F.floor("price").cast("double").alias("whole"),
        decade(F.col("price")).cast("double").alias("decade"),
        "n",
    )
