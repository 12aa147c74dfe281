"""Price-ending shares, league tables, store profiles and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ends_cent_nine, ends_unit_nine, with_endings
from ..operators.cells import CELL_KEY, mean_cents
from ..operators.shares import (
    chain_league,
    correlations,
    density,
    describe,
    ending_share,
    histogram,
    mean_and_std,
    mean_by,
    sample_variances,
    store_profile,
)
from . import views
from .base_queries import ENDING_TESTS
from .registry import query, rounded, sql_r6
from .views import PRICE_CELLS_SQL, SCAN_LINES_SQL

FLAGS = ["unit_nine", "cent_nine"]
ALL_FLAGS = ["any_nine", *FLAGS]

REGION_GROUPS = {"AFRICA": "Group 1", "AMERICA": "Group 2", "ASIA": "Group 3"}

# Lines with the two flags of definition A on sales.
LINES_A_SQL = f"""{SCAN_LINES_SQL},
flagged AS (SELECT *, CAST(kron = 9 AS INTEGER) AS unit_nine, CAST(ore >= 0.9 AS INTEGER) AS cent_nine FROM scan_lines)"""

# Plausible cells with the flags of definition B on the modal price.
_unit, _cent = (t.replace("price", "ppu") for t in ENDING_TESTS["B"])
CELLS_B_SQL = f"""{PRICE_CELLS_SQL},
kept AS (SELECT * FROM price_cells WHERE price > 0 AND price < 100 AND quantity > 0 AND quantity < 201),
flag_b AS (SELECT *, {_unit} AS u, {_cent} AS c FROM kept),
flagged AS (
  SELECT *, CAST(u AS INTEGER) AS unit_nine, CAST(c AS INTEGER) AS cent_nine,
         CAST(u OR c AS INTEGER) AS any_nine, price * quantity AS sales FROM flag_b
)"""

STORES_B_SQL = f"""{CELLS_B_SQL},
profile AS (
  SELECT store_id, avg(any_nine) AS any_nine, avg(unit_nine) AS unit_nine, avg(cent_nine) AS cent_nine,
         min(kjedeid) AS kjedeid, CAST(sum(trans) AS BIGINT) AS trans, sum(sales) AS sales
  FROM flagged GROUP BY store_id
)"""


def lines_a(spark, sf_dir):
    return views.scan_lines(spark, sf_dir).withColumns(
        {"unit_nine": F.col("kron") == 9, "cent_nine": F.col("ore") >= 0.9}
    )


def cells_b(spark, sf_dir):
    from ..operators.clean import plausible

    cells = plausible(views.price_cells(spark, sf_dir))
    return with_endings(cells, "ppu", "B").withColumn("sales", F.col("price") * F.col("quantity"))


def profiles(spark, sf_dir):
    return store_profile(cells_b(spark, sf_dir), "store_id", ALL_FLAGS, ["trans", "sales"], "kjedeid")


def _register_share(name, by):
    keys = ", ".join(by)
    flags = ", ".join(f"{sql_r6(f'avg({f})')} AS {f}" for f in FLAGS)

    @query(
        name,
        f"WITH {LINES_A_SQL} SELECT {keys + ', ' if by else ''}{flags} FROM flagged "
        + (f"GROUP BY {keys}" if by else ""),
    )
    def shares(spark, sf_dir):
        return rounded(ending_share(lines_a(spark, sf_dir), by, FLAGS), FLAGS)


_register_share("share_overall", [])
_register_share("share_by_owner", ["paraplykjede"])
_register_share("share_by_chain", ["paraplykjede", "kjedeid"])
_register_share("share_by_store_week", ["store_id", "week", "kjedeid"])
_register_share("share_by_sku", ["sku_gtin"])


@query(
    "share_modal_price",
    f"""WITH {PRICE_CELLS_SQL}
SELECT kjedeid, {sql_r6("avg(CAST(CAST(floor(ppu) AS BIGINT) % 10 = 9 AS INTEGER))")} AS unit_nine,
       {sql_r6("avg(CAST(round(ppu - floor(ppu), 2) >= 0.9 AS INTEGER))")} AS cent_nine
FROM price_cells GROUP BY kjedeid""",
)
def share_modal_price(spark, sf_dir):
    """Definition A on the modal price of each cell."""
    flagged = with_endings(views.price_cells(spark, sf_dir), "ppu", "A")
    return rounded(ending_share(flagged, ["kjedeid"], FLAGS), FLAGS)


@query(
    "share_mean_price",
    f"""WITH {PRICE_CELLS_SQL}, whole AS (
  SELECT kjedeid, sum(CAST(round(ppu * 100) AS BIGINT)) AS cents, count(*) AS n
  FROM price_obs GROUP BY month, week, sku_gtin, store_id, kjedeid),
priced AS (SELECT kjedeid, CAST((2 * cents + n) // (2 * n) AS BIGINT) AS p FROM whole)
SELECT kjedeid, {sql_r6("avg(CAST(p // 100 % 10 = 9 AS INTEGER))")} AS unit_nine,
       {sql_r6("avg(CAST(p % 100 >= 90 AS INTEGER))")} AS cent_nine
FROM priced GROUP BY kjedeid""",
)
def share_mean_price(spark, sf_dir):
    """Definition A on the mean price of each cell, rounded half up to whole cents by integers."""
    priced = mean_cents(views.price_obs(spark, sf_dir), [*CELL_KEY, "kjedeid"], "ppu")
    priced = priced.withColumn("price", F.col("mean_cents") / 100)
    return rounded(ending_share(with_endings(priced, "price", "A"), ["kjedeid"], FLAGS), FLAGS)


@query(
    "chain_ending_league",
    f"""WITH {LINES_A_SQL}, t AS (
  SELECT kjedeid, paraplykjede, avg(unit_nine) AS u, avg(cent_nine) AS c FROM flagged GROUP BY ALL)
SELECT kjedeid, paraplykjede, {sql_r6("u")} AS unit_nine, {sql_r6("c")} AS cent_nine,
       row_number() OVER (ORDER BY u, kjedeid) AS "row",
       CASE paraplykjede WHEN 'AFRICA' THEN 'Group 1' WHEN 'AMERICA' THEN 'Group 2'
                         WHEN 'ASIA' THEN 'Group 3' END AS owner_lab FROM t""",
)
def chain_ending_league(spark, sf_dir):
    league = chain_league(lines_a(spark, sf_dir), "kjedeid", "paraplykjede", FLAGS, REGION_GROUPS)
    return rounded(league, FLAGS)


@query(
    "price_by_chain_week",
    f"""WITH {PRICE_CELLS_SQL}
SELECT kjedeid, week, {sql_r6("avg(price)")} AS price FROM price_cells WHERE kjedeid <> 'chain_3' GROUP BY ALL""",
)
def price_by_chain_week(spark, sf_dir):
    cells = views.price_cells(spark, sf_dir).where(F.col("kjedeid") != "chain_3")
    return rounded(mean_by(cells, ["kjedeid", "week"], ["price"]), ["price"])


@query(
    "store_mixed_agg",
    f"""WITH {STORES_B_SQL}
SELECT store_id, {sql_r6("any_nine")} AS any_nine, {sql_r6("unit_nine")} AS unit_nine,
       {sql_r6("cent_nine")} AS cent_nine, kjedeid, trans, {sql_r6("sales")} AS sales FROM profile""",
)
def store_mixed_agg(spark, sf_dir):
    return rounded(profiles(spark, sf_dir), [*ALL_FLAGS, "sales"])


@query(
    "chain_mean_std",
    f"""WITH {STORES_B_SQL}
SELECT kjedeid, {", ".join(f"{sql_r6(f'avg({f})')} AS {f}_mean, {sql_r6(f'stddev_samp({f})')} AS {f}_std" for f in FLAGS)}
FROM profile GROUP BY kjedeid""",
)
def chain_mean_std(spark, sf_dir):
    table = mean_and_std(profiles(spark, sf_dir), ["kjedeid"], FLAGS)
    return rounded(table, [c for c in table.columns if c != "kjedeid"])


@query(
    "global_means",
    f"WITH {STORES_B_SQL} SELECT "
    + ", ".join(f"{sql_r6(f'avg({f})')} AS {f}" for f in FLAGS)
    + " FROM profile",
)
def global_means(spark, sf_dir):
    return rounded(mean_by(profiles(spark, sf_dir), [], FLAGS), FLAGS)


_DESCRIBE_PARTS = " UNION ALL ".join(
    f"""SELECT '{f}' AS "column", count({f}) AS count, {sql_r6(f"avg({f})")} AS mean,
    {sql_r6(f"stddev_samp({f})")} AS std, {sql_r6(f"min({f})")} AS min, {sql_r6(f"quantile_cont({f}, 0.25)")} AS q25,
    {sql_r6(f"quantile_cont({f}, 0.5)")} AS q50, {sql_r6(f"quantile_cont({f}, 0.75)")} AS q75, {sql_r6(f"max({f})")} AS max
    FROM profile"""
    for f in ALL_FLAGS
)


@query("describe_store", f"WITH {STORES_B_SQL} {_DESCRIBE_PARTS}")
def describe_store(spark, sf_dir):
    table = describe(profiles(spark, sf_dir), ALL_FLAGS)
    return rounded(table, ["mean", "std", "min", "q25", "q50", "q75", "max"])


PAIRS = [(f, m) for f in ("cent_nine", "unit_nine") for m in ("trans", "sales")]


@query(
    "corr_pairs",
    f"WITH {STORES_B_SQL} SELECT "
    + ", ".join(f"{sql_r6(f'corr({a}, {b})')} AS {a}__{b}" for a, b in PAIRS)
    + " FROM profile",
)
def corr_pairs(spark, sf_dir):
    table = correlations(profiles(spark, sf_dir), PAIRS)
    return rounded(table, table.columns)


@query(
    "flag_variances",
    f"WITH {CELLS_B_SQL} SELECT "
    + ", ".join(f"{sql_r6(f'var_samp({f})')} AS {f}" for f in ALL_FLAGS)
    + " FROM flagged",
)
def flag_variances(spark, sf_dir):
    cells = cells_b(spark, sf_dir).withColumns({f: F.col(f).cast("int") for f in ALL_FLAGS})
    return rounded(sample_variances(cells, ALL_FLAGS), ALL_FLAGS)


def _histogram_sql(column, bins, by):
    keys = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    return f"""{STORES_B_SQL}, ranged AS (
  SELECT {keys}{column} AS v, min({column}) OVER ({over}) AS lo0, max({column}) OVER ({over}) AS hi0
  FROM profile WHERE {column} IS NOT NULL),
bounded AS (SELECT *, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                   CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM ranged),
hist AS (
  SELECT {keys}CAST(least(floor((v - lo) / (hi - lo) * {bins}), {bins} - 1) AS INTEGER) AS bin, lo,
         (hi - lo) / {bins} AS width, count(*) AS n FROM bounded GROUP BY ALL)"""


_HIST_COLUMNS = f"bin, {sql_r6('lo + bin * width')} AS bin_start, {sql_r6('width')} AS width, n"


@query("hist_all", f"WITH {_histogram_sql('unit_nine', 60, None)} SELECT {_HIST_COLUMNS} FROM hist")
def hist_all(spark, sf_dir):
    table = histogram(profiles(spark, sf_dir), "unit_nine", 60)
    return rounded(table, ["bin_start", "width"]).withColumn("n", F.col("n").cast("long"))


@query(
    "hist_by_chain",
    f"WITH {_histogram_sql('cent_nine', 30, 'kjedeid')} SELECT kjedeid, {_HIST_COLUMNS} FROM hist",
)
def hist_by_chain(spark, sf_dir):
    table = histogram(profiles(spark, sf_dir), "cent_nine", 30, ["kjedeid"])
    return rounded(table, ["bin_start", "width"])


@query(
    "density_by_chain",
    f"""WITH {_histogram_sql('unit_nine', 30, 'kjedeid')}
SELECT kjedeid, {_HIST_COLUMNS}, {sql_r6("n / (sum(n) OVER (PARTITION BY kjedeid) * width)")} AS density FROM hist""",
)
def density_by_chain(spark, sf_dir):
    table = density(profiles(spark, sf_dir), "unit_nine", 30, ["kjedeid"])
    return rounded(table, ["bin_start", "width", "density"])


def _register_text_ending_shares():
    unit, cent = (t.replace("price", "ppu") for t in ENDING_TESTS["D"])

    @query(
        "share_by_store_text_endings",
        f"""WITH {PRICE_CELLS_SQL},
kept AS (SELECT * FROM price_cells WHERE price > 0 AND price < 1000 AND quantity > 0 AND quantity < 201)
SELECT store_id, kjedeid, {sql_r6(f"avg(CAST({unit} AS INTEGER))")} AS unit_nine,
       {sql_r6(f"avg(CAST({cent} AS INTEGER))")} AS cent_nine,
       {sql_r6(f"avg(CAST({unit} OR {cent} AS INTEGER))")} AS any_nine FROM kept GROUP BY store_id, kjedeid""",
    )
    def share_by_store_text_endings(spark, sf_dir):
        """Definition D on the modal price, with the wider price cap."""
        from ..operators.clean import plausible

        cells = with_endings(plausible(views.price_cells(spark, sf_dir), 1000), "ppu", "D")
        return rounded(ending_share(cells, ["store_id", "kjedeid"], ALL_FLAGS), ALL_FLAGS)


_register_text_ending_shares()


@query(
    "price_point_shares",
    f"""WITH {SCAN_LINES_SQL}, points AS (
  SELECT store_id, week, kjedeid, ppu, count(*) AS n FROM scan_lines GROUP BY ALL)
SELECT kjedeid, {sql_r6("avg(CAST(CAST(floor(ppu) AS BIGINT) % 10 = 9 AS INTEGER))")} AS unit_nine,
       {sql_r6("avg(CAST(round(ppu - floor(ppu), 2) >= 0.9 AS INTEGER))")} AS cent_nine, count(*) AS points
FROM points GROUP BY kjedeid""",
)
def price_point_shares(spark, sf_dir):
    """Shares over distinct price points of a store and week rather than over lines."""
    from ..operators.cells import price_points

    points = price_points(views.scan_lines(spark, sf_dir), ["store_id", "week", "kjedeid"])
    flagged = points.select(
        "kjedeid",
        ends_unit_nine(F.col("ppu"), "A").alias("unit_nine"),
        ends_cent_nine(F.col("ppu"), "A").alias("cent_nine"),
    )
    counted = flagged.groupBy("kjedeid").agg(
        *[F.avg(F.col(f).cast("int")).alias(f) for f in FLAGS], F.count(F.lit(1)).alias("points")
    )
    return rounded(counted, FLAGS)
