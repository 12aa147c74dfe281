"""Every fitted model: factor models, fixed effects, clustered errors, instruments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ends_cent_nine, ends_unit_nine, price_grid, with_endings
from ..operators.cells import price_points
from ..operators.clean import plausible
from ..operators.dynamics import group_mean_instrument, market_min_response
from ..operators.levels import component_effects
from ..operators.regress import (
    INTERCEPT,
    Factor,
    fe_ols,
    fit_panel,
    fixed_effects,
    iv_2sls,
    make_panel,
    model_table,
    score_rows,
    with_fitted,
    with_interactions,
)
from ..functions.scalars import STAR_LEVELS
from ..operators.shares import ending_share
from ..session import materialise
from . import dynamics_queries, views
from .base_queries import ENDING_TESTS
from .oracle import absorb_ctes, ols_sql
from .registry import NUDGE, query, r6, rounded, sql_r6
from .share_queries import CELLS_B_SQL, LINES_A_SQL, cells_b, lines_a
from .views import PRICE_CELLS_SQL, SCAN_LINES_SQL, STORE_GEO_SQL

TIDY = ["estimate", "std_error"]


def _r4(column):
    """Four digits: both sides converge far below, so that no row straddles a rounding step by chance."""
    return F.round(F.col(column) + F.lit(NUDGE), 4) + F.lit(0.0)


def _sql_r4(expression):
    return f"(round(({expression})::DOUBLE + {NUDGE!r}, 4) + 0.0)"


def tidy(fit, *by):
    return rounded(fit.tidy().select(*by, "term", *TIDY, "n_obs"), TIDY)


# --- factor models on store-week shares ---------------------------------------

STORE_WEEK_SQL = f"""{LINES_A_SQL}, store_week AS (
  SELECT store_id, week, kjedeid, paraplykjede, avg(unit_nine) AS avg_kron, avg(cent_nine) AS avg_ore
  FROM flagged GROUP BY ALL)"""

# Formats go by groups of five chains.
FORMAT_OF = {"chain_0": "convenience", "chain_1": "discount", "chain_2": "discount", "chain_3": "hypermarket", "chain_4": "supermarket"}

_ROLE_SQL = "'chain_' || CAST(CAST(replace(kjedeid, 'NATION_', '') AS INTEGER) // 5 AS VARCHAR)"
_FORMAT_SQL = "CASE role WHEN 'chain_0' THEN 'convenience' WHEN 'chain_3' THEN 'hypermarket' WHEN 'chain_4' THEN 'supermarket' ELSE 'discount' END"

STORE_WEEK_ROLES_SQL = f"""{STORE_WEEK_SQL}, roles AS (SELECT *, {_ROLE_SQL} AS role FROM store_week),
shares AS (SELECT *, {_FORMAT_SQL} AS format, 1.0::DOUBLE AS one FROM roles)"""


def with_roles(df):
    number = F.floor(F.regexp_extract("kjedeid", r"(\d+)", 1).cast("int") / 5)
    role = F.concat(F.lit("chain_"), number.cast("string"))
    table = F.create_map(*[F.lit(v) for kv in FORMAT_OF.items() for v in kv])
    return df.withColumn("role", role).withColumn("format", table[F.col("role")])


def store_week_shares(spark, sf_dir):
    flagged = lines_a(spark, sf_dir).withColumnsRenamed({"unit_nine": "avg_kron", "cent_nine": "avg_ore"})
    by = ["store_id", "week", "kjedeid", "paraplykjede"]
    return with_roles(ending_share(flagged, by, ["avg_kron", "avg_ore"]))


def _dummy_ctes(source, column, levels, reference):
    """A common table with one 0/1 column per level but the reference."""
    names = {f"d{i}": lev for i, lev in enumerate(levels) if lev != reference}
    cols = ", ".join(f"CAST({column} = '{lev}' AS INTEGER)::DOUBLE AS {n}" for n, lev in names.items())
    return f"dummied AS (SELECT *, {cols} FROM {source})", names


def _register_factor(name, y, factor, levels, reference, absorb=(), source="shares", ctes=STORE_WEEK_ROLES_SQL, rows=store_week_shares):
    dummies, names = _dummy_ctes(source, factor, levels, reference)
    x = [*names, *([] if absorb else ["one"])]
    terms = {n: f"{factor}[{lev}]" for n, lev in names.items()} | {"one": INTERCEPT}
    dims = [[d] for d in absorb]

    @query(name, ols_sql(f"{ctes}, {dummies}", "dummied", y, x, dims, cluster=["store_id"], terms=terms))
    def model(spark, sf_dir):
        fit = fe_ols(
            rows(spark, sf_dir), y, [], [Factor(factor, reference)], absorb, ["store_id"], vcov="cluster"
        )
        return tidy(fit)


def _chain_means_sql(ctes, source, y, reference):
    """A regression on chains alone, from the chains' means; a store's influence on a mean gives clustered errors."""
    return f"""WITH {ctes},
means AS (SELECT kjedeid AS level, count(*) AS n, avg({y}) AS m FROM {source} GROUP BY ALL),
refs AS (SELECT n, m FROM means WHERE level = '{reference}'),
size AS (SELECT sum(n) AS n, count(*) AS k, (SELECT count(DISTINCT store_id) FROM {source}) AS g FROM means),
scores AS (SELECT store_id, level, sum({y} - m) / any_value(means.n) AS s FROM {source} JOIN means ON kjedeid = level GROUP BY ALL),
influence AS (SELECT means.level, store_id,
    sum(CASE WHEN scores.level = means.level THEN s ELSE 0 END)
    - sum(CASE WHEN scores.level = '{reference}' AND means.level <> '{reference}' THEN s ELSE 0 END) AS i
  FROM means CROSS JOIN scores GROUP BY ALL),
spread AS (SELECT level, sum(i * i) AS v FROM influence GROUP BY level)
SELECT CASE WHEN level = '{reference}' THEN '{INTERCEPT}' ELSE 'kjedeid[' || level || ']' END AS term,
  {sql_r6(f"means.m - CASE WHEN level = '{reference}' THEN 0 ELSE refs.m END")} AS estimate,
  {sql_r6("sqrt(v * size.g / (size.g - 1.0::DOUBLE) * (size.n - 1.0::DOUBLE) / (size.n - size.k))")} AS std_error,
  CAST(size.n AS BIGINT) AS n_obs
FROM means JOIN spread USING (level) CROSS JOIN refs CROSS JOIN size"""


def _register_chain(name, y, ctes=STORE_WEEK_ROLES_SQL, rows=store_week_shares, reference="NATION_3"):
    @query(name, _chain_means_sql(ctes, "shares", y, reference))
    def model(spark, sf_dir):
        return tidy(fe_ols(rows(spark, sf_dir), y, [], [Factor("kjedeid", reference)], (), ["store_id"], vcov="cluster"))


OWNERS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
FORMATS = ["convenience", "discount", "hypermarket", "supermarket"]

_register_factor("ols_owner_unit", "avg_kron", "paraplykjede", OWNERS, "AFRICA")
_register_factor("ols_owner_cent", "avg_ore", "paraplykjede", OWNERS, "AFRICA")
_register_chain("ols_chain_unit", "avg_kron")
_register_chain("ols_chain_cent", "avg_ore")
_register_factor("ols_format_unit", "avg_kron", "format", FORMATS, "convenience")
_register_factor("ols_format_cent", "avg_ore", "format", FORMATS, "convenience")

# The same models on distinct price points, one row per price of a store-week.
POINTS_SQL = f"""{SCAN_LINES_SQL}, points AS (
  SELECT store_id, week, kjedeid, paraplykjede, ppu, count(*) AS n FROM scan_lines GROUP BY ALL),
roles AS (SELECT *, {_ROLE_SQL} AS role, 1.0::DOUBLE AS one,
  CAST(CAST(floor(ppu) AS BIGINT) % 10 = 9 AS INTEGER)::DOUBLE AS avg_kron,
  CAST(round(ppu - floor(ppu), 2) >= 0.9 AS INTEGER)::DOUBLE AS avg_ore FROM points),
shares AS (SELECT *, {_FORMAT_SQL} AS format FROM roles)"""


def point_shares(spark, sf_dir):
    points = price_points(views.scan_lines(spark, sf_dir), ["store_id", "week", "kjedeid", "paraplykjede"])
    flags = {
        "avg_kron": ends_unit_nine(F.col("ppu"), "A"),
        "avg_ore": ends_cent_nine(F.col("ppu"), "A"),
    }
    return with_roles(points.withColumns(flags))


_points = {"ctes": POINTS_SQL, "rows": point_shares}
_register_factor("points_owner_unit_week", "avg_kron", "paraplykjede", OWNERS, "AFRICA", ["week"], **_points)
_register_factor("points_owner_cent_week", "avg_ore", "paraplykjede", OWNERS, "AFRICA", ["week"], **_points)
_register_chain("points_chain_unit", "avg_kron", **_points)
_register_chain("points_chain_cent", "avg_ore", **_points)
_register_factor("points_format_unit_owner", "avg_kron", "format", FORMATS, "convenience", ["paraplykjede"], **_points)
_register_factor("points_format_cent_owner", "avg_ore", "format", FORMATS, "convenience", ["paraplykjede"], **_points)


# --- store shares on local monopoly and chain ----------------------------------

MONOPOLY_KM = [0.5, 1, 2]
_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
STORE_MONOPOLY_SQL = f"""{LINES_A_SQL}, {STORE_GEO_SQL},
profile AS (SELECT store_id, avg(unit_nine) AS unit_nine, avg(cent_nine) AS cent_nine, min(kjedeid) AS kjedeid
  FROM flagged GROUP BY store_id),
near AS (SELECT CAST(a.id AS VARCHAR) AS store_id, min({_D}) AS d FROM store_geo AS a
  JOIN store_geo AS b ON a.kjedeid <> b.kjedeid GROUP BY a.id),
placed AS (SELECT p.*, {", ".join(f"CAST(d > {r * 1000} AS INTEGER)::DOUBLE AS mono{i}" for i, r in enumerate(MONOPOLY_KM))}
  FROM profile AS p JOIN near USING (store_id))"""


def store_monopoly(spark, sf_dir):
    from ..operators.geo import nearest_store
    from ..operators.shares import store_profile

    profile = store_profile(lines_a(spark, sf_dir), "store_id", ["unit_nine", "cent_nine"], [], "kjedeid")
    near = nearest_store(views.store_geo(spark, sf_dir), "id", "x", "y", differ_on="kjedeid")
    near = near.select(F.col("id").cast("string").alias("store_id"), "min_distance")
    flags = {f"mono{i}": (F.col("min_distance") > r * 1000).cast("double") for i, r in enumerate(MONOPOLY_KM)}
    return profile.join(near, "store_id").withColumns(flags)


def _monopoly_sql(y, x, reference):
    """The chains are taken out as means; what is left of the flag has a single coefficient."""
    return f"""WITH {STORE_MONOPOLY_SQL},
means AS (SELECT kjedeid AS level, count(*) AS n, avg({y}) AS my, avg({x}) AS mx FROM placed GROUP BY ALL),
refs AS (SELECT n, my, mx FROM means WHERE level = '{reference}'),
centred AS (SELECT {y} - my AS y, {x} - mx AS x FROM placed JOIN means ON kjedeid = level),
slope AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx FROM centred),
size AS (SELECT (SELECT sum(pow(y - b * x, 2)) FROM centred, slope) / (sum(n) - count(*) - 1) AS s2, sum(n) AS n FROM means)
SELECT '{x}' AS term, {sql_r6("b")} AS estimate, {sql_r6("sqrt(s2 / sxx)")} AS std_error, CAST(n AS BIGINT) AS n_obs FROM slope, size
UNION ALL SELECT '{INTERCEPT}', {sql_r6("my - b * mx")}, {sql_r6("sqrt(s2 * (1.0 / refs.n + mx * mx / sxx))")}, CAST(size.n AS BIGINT)
  FROM refs, slope, size
UNION ALL SELECT 'kjedeid[' || level || ']', {sql_r6("means.my - refs.my - b * (means.mx - refs.mx)")},
  {sql_r6("sqrt(s2 * (1.0 / means.n + 1.0 / refs.n + pow(means.mx - refs.mx, 2) / sxx))")}, CAST(size.n AS BIGINT)
  FROM means, refs, slope, size WHERE level <> '{reference}'"""


def _register_monopoly(y, i):
    @query(f"ols_monopoly_{y}_{MONOPOLY_KM[i]:g}km".replace(".", "_"), _monopoly_sql(y, f"mono{i}", "NATION_0"))
    def model(spark, sf_dir):
        return tidy(fe_ols(store_monopoly(spark, sf_dir), y, [f"mono{i}"], [Factor("kjedeid", "NATION_0")]))


for _y in ("unit_nine", "cent_nine"):
    for _i in range(len(MONOPOLY_KM)):
        _register_monopoly(_y, _i)


# --- cell-level models ----------------------------------------------------------

CELLS_LOG_SQL = f"""{PRICE_CELLS_SQL},
logged AS (
  SELECT *, CAST(store_id AS BIGINT) % 7 AS municipality, sku_gtin % 10 AS sku_group,
    substr(kjedeid, 7, 1)::INTEGER % 3 AS owner_no, floor(ppu) AS fl,
    ln(trans + 1) AS log_trans1, ln(quantity) AS log_quantity, ln(quantity + 1) AS log_quantity1, ln(trans) AS log_trans,
    ln(ppu) AS log_price,
    CAST(CAST(floor(ppu) AS BIGINT) % 10 = 9 AS INTEGER)::DOUBLE AS unit_nine,
    CAST(CAST(round_even(ppu * 100, 0) AS BIGINT) % 100 IN (90, 95, 99) AS INTEGER)::DOUBLE AS cent_nine
  FROM price_cells WHERE ppu > 0 AND price > 0 AND price < 1000 AND quantity > 0 AND quantity < 201),
cells_log AS (SELECT *, log_price * unit_nine AS log_price_unit, log_price * cent_nine AS log_price_cent,
    unit_nine * cent_nine AS unit_cent, 'owner_' || owner_no AS owner FROM logged)"""


def cells_log(spark, sf_dir):
    cells = plausible(views.price_cells(spark, sf_dir), 1000).where(F.col("ppu") > 0)
    flagged = with_endings(cells, "ppu", "B")
    flagged = flagged.withColumns(
        {
            "municipality": F.col("store_id").cast("long") % 7,
            "sku_group": F.col("sku_gtin") % 10,
            "owner": F.concat(
                F.lit("owner_"), (F.substring("kjedeid", 7, 1).cast("int") % 3).cast("string")
            ),
            "floor": F.floor("ppu").cast("double"),
            "log_trans1": F.log1p("trans"),
            "log_trans": F.ln("trans"),
            "log_quantity": F.ln("quantity"),
            "log_quantity1": F.log1p("quantity"),
            "log_price": F.ln("ppu"),
        }
    )
    pairs = {
        "log_price_unit": ("log_price", "unit_nine"),
        "log_price_cent": ("log_price", "cent_nine"),
        "unit_cent": ("unit_nine", "cent_nine"),
    }
    return with_interactions(flagged, pairs)


def _register_cells_model(name, y, x, absorb, cluster=(), by=(), sweeps=10, fe_dof="all"):
    dims = [[d] for d in absorb]
    options = {"by": list(by), "cluster": list(cluster), "sweeps": sweeps, "fe_dof": fe_dof}

    @query(name, ols_sql(CELLS_LOG_SQL, "cells_log", y, x, dims, **options))
    def model(spark, sf_dir):
        vcov = "cluster" if cluster else "iid"
        fit = fe_ols(cells_log(spark, sf_dir), y, x, (), absorb, cluster, by, vcov, fe_dof)
        return tidy(fit, *by)


_register_cells_model("fe_ols_1way", "log_quantity", ["log_price", "unit_nine"], ["sku_gtin"])
_register_cells_model("fe_demand_by_owner", "log_trans1", ["log_price", "unit_nine", "cent_nine"], ["sku_gtin", "week", "store_id"], ["store_id"], ["owner"], 14)
_register_cells_model("fe_demand_by_category", "log_quantity1", ["log_price", "unit_nine", "cent_nine", "unit_cent"], ["week", "sku_gtin"], ["store_id"], ["sku_group"])
_register_cells_model("fe_quantity_two_way", "log_quantity", ["log_price", "unit_nine", "cent_nine"], ["sku_gtin", "store_id"])
_register_cells_model("fe_quantity_interaction", "log_quantity", ["log_price", "unit_nine", "log_price_unit"], ["sku_gtin", "store_id"])
_register_cells_model("cluster_se_1way", "log_trans", ["log_price", "unit_nine", "cent_nine"], ["sku_gtin", "store_id"], ["store_id"], (), 10, "none")
_register_cells_model("cluster_se_2way", "log_trans", ["log_price", "unit_nine", "cent_nine"], ["sku_gtin", "store_id"], ["sku_gtin", "store_id"])
_register_cells_model("fe_trans_interaction", "log_trans", ["log_price", "cent_nine", "log_price_cent"], ["sku_gtin", "store_id"])
_register_cells_model("fe_trans_full", "log_trans", ["log_price", "unit_nine", "cent_nine", "log_price_unit", "log_price_cent"], ["sku_gtin", "store_id", "week"])


# --- demand within each category, with chains ------------------------------------

CATEGORY_SQL = f"""{CELLS_LOG_SQL}, labelled AS (
  SELECT * REPLACE (
    CAST(CAST(floor(ppu) AS BIGINT) % 10 = 9 AS INTEGER)::DOUBLE AS unit_nine,
    CAST(round(ppu - floor(ppu), 2) >= 0.9 AS INTEGER)::DOUBLE AS cent_nine)
  FROM cells_log WHERE fl <= 100),
categorised AS (SELECT * REPLACE (unit_nine * cent_nine AS unit_cent),
  {", ".join(f"CAST(kjedeid = 'chain_{c}' AS INTEGER)::DOUBLE AS chain_{c}" for c in range(1, 5))} FROM labelled)"""


def category_cells(spark, sf_dir):
    """Cells with endings by definition A and bins of at most 100, each with its category."""
    cells = with_endings(cells_log(spark, sf_dir).where(F.col("floor") <= 100), "ppu", "A")
    return with_interactions(cells, {"unit_cent": ("unit_nine", "cent_nine")})


@query(
    "fe_demand_by_category_chain",
    ols_sql(
        CATEGORY_SQL, "categorised", "log_quantity1",
        ["log_price", "unit_nine", "cent_nine", "unit_cent", "chain_1", "chain_2", "chain_3", "chain_4"],
        [["week"], ["sku_gtin"]], by=["sku_group"], cluster=["store_id"], terms={f"chain_{c}": f"kjedeid[chain_{c}]" for c in range(1, 5)},
    ),
)
def fe_demand_by_category_chain(spark, sf_dir):
    """Demand per category on price, both endings, their product and chains; week and product absorbed, errors by store."""
    x = ["log_price", "unit_nine", "cent_nine", "unit_cent"]
    chains = Factor("kjedeid", "chain_0", tuple(f"chain_{c}" for c in range(5)))
    fit = fe_ols(
        category_cells(spark, sf_dir), "log_quantity1", x, [chains], ["week", "sku_gtin"], ["store_id"], ["sku_group"], vcov="cluster"
    )
    return tidy(fit, "sku_group")


def _register_owner_fe():
    dummies, names = _dummy_ctes("cells_log", "owner", ["owner_0", "owner_1", "owner_2"], "owner_0")
    terms = {n: f"owner[{lev}]" for n, lev in names.items()}

    @query(
        "fe_ols_2way_owner",
        ols_sql(f"{CELLS_LOG_SQL}, {dummies}", "dummied", "unit_nine", list(names), [["sku_gtin"], ["week"]], cluster=["store_id"], terms=terms),
    )
    def model(spark, sf_dir):
        fit = fe_ols(cells_log(spark, sf_dir), "unit_nine", [], [Factor("owner")], ["sku_gtin", "week"], ["store_id"], vcov="cluster")
        return tidy(fit)


_register_owner_fe()


# --- response to last week's lowest price ---------------------------------------

_RESPONSES = {
    "market_response_plain": [],
    "market_response_round": ["min_price_lag_int"],
    "market_response_nines": ["min_price_lag_int", "min_price_lag_ldp"],
}


def _register_response(name, interact):
    base = ["price_at_min_lag", "price_lower_lag"]
    products = {f"{b}__{m}": (b, m) for m in interact for b in base}
    x = [*base, *interact, *products]
    flags = [*base, "min_price_lag_int", "min_price_lag_ldp", "ppu_ldp"]
    source = dynamics_queries.MARKET_MIN_SQL["store" if interact else "sku"].replace("WITH ", "", 1)
    head, body = source[: source.rindex("SELECT kjedeid, sku_gtin, week, ppu")], source[source.rindex("SELECT kjedeid, sku_gtin, week, ppu") :]
    numbers = ", ".join(f"CAST({f} AS INTEGER)::DOUBLE AS {f}" for f in flags)
    multiplied = "".join(f", {a} * {b} AS {n}" for n, (a, b) in products.items())
    ctes = f"""{head.rstrip()}, response AS ({body}),
numeric AS (SELECT sku_gtin, week, {numbers} FROM response), designed AS (SELECT *{multiplied} FROM numeric)"""

    # In the test tables no chain sits exactly at a lagged minimum that is round
    # or ends in nine, so these products never vary and are listed as dropped.
    empty = [n for n in products if n.startswith("price_at_min_lag")]
    sql = ols_sql(ctes, "designed", "ppu_ldp", [c for c in x if c not in empty], [["sku_gtin"], ["week"]])
    for n in empty:
        sql += f"\nUNION ALL SELECT '{n}', NULL::DOUBLE, NULL::DOUBLE, count(*) FROM designed"

    @query(name, sql)
    def model(spark, sf_dir):
        cells = cells_b(spark, sf_dir)
        if interact:
            # With many chains the market minimum never ends in nine here; a
            # product sold by one chain has minima of every kind.
            cells = cells.withColumn("sku_gtin", F.col("store_id").cast("long"))
        table = market_min_response(cells, "sku")
        table = with_interactions(table, products) if products else table
        return tidy(fe_ols(table, "ppu_ldp", x, (), ["sku_gtin", "week"]))


for _name, _interact in _RESPONSES.items():
    _register_response(_name, _interact)


# --- instruments -----------------------------------------------------------------

IV_FE = ["sku_gtin", "store_id", "week"]
IV_SQL = f"""{CELLS_LOG_SQL}, priced AS (
  SELECT *, ln(avg(ppu) OVER (PARTITION BY sku_gtin, week, kjedeid)) AS log_price_iv FROM cells_log)"""


def iv_cells(spark, sf_dir):
    table = group_mean_instrument(cells_log(spark, sf_dir), ["sku_gtin", "week", "kjedeid"])
    return table.withColumn("log_price_iv", F.ln("price_iv"))


FIRST = ["log_price_iv", "unit_nine", "cent_nine"]


@query(
    "iv_first_stage",
    ols_sql(IV_SQL, "priced", "log_price", FIRST, [[d] for d in IV_FE], cluster=["store_id"]),
)
def iv_first_stage(spark, sf_dir):
    fit = fe_ols(iv_cells(spark, sf_dir), "log_price", FIRST, (), IV_FE, ["store_id"], vcov="cluster")
    return tidy(fit)


@query(
    "iv_2sls",
    ols_sql(
        IV_SQL,
        "priced",
        "log_quantity",
        ["log_price"],
        [[d] for d in IV_FE],
        cluster=["store_id"],
        instruments=["log_price_iv"],
    ),
)
def iv_2sls_query(spark, sf_dir):
    fit = iv_2sls(
        iv_cells(spark, sf_dir), "log_quantity", ["log_price"], ["log_price_iv"], (), IV_FE, ["store_id"], vcov="cluster"
    )
    return tidy(fit)


# Second stages share one demeaned panel of the fitted price and its products.
SECOND = {
    "two_stage_plain": ["log_price_hat"],
    "two_stage_unit": ["log_price_hat", "unit_nine", "log_price_unit_hat"],
    "two_stage_cent": ["log_price_hat", "cent_nine", "log_price_cent_hat"],
    "two_stage_full": ["log_price_hat", "unit_nine", "log_price_unit_hat", "cent_nine", "log_price_cent_hat"],
}


def with_price_hat(spark, sf_dir):
    """Rows with the first stage's fitted price, fixed effects included."""
    needed = ["log_quantity", "log_price", *FIRST, "store_id", "kjedeid", "sku_gtin", "week"]
    rows = materialise(iv_cells(spark, sf_dir).select(*needed))
    first = fe_ols(rows, "log_price", FIRST, (), IV_FE)
    rows = with_fitted(rows, first, fitted="log_price_hat")
    pairs = {
        "log_price_unit_hat": ("log_price_hat", "unit_nine"),
        "log_price_cent_hat": ("log_price_hat", "cent_nine"),
    }
    return with_interactions(rows, pairs)


def _hat_sql():
    """The fitted price is the log price minus the residual of the first stage."""
    demeaned, last = absorb_ctes("keyed", [[d] for d in IV_FE], ["r_y", "r_1", "r_2", "r_3"], 10, prefix="fs")
    g = ", ".join(
        [f"sum(r_{i} * r_{j}) AS a_{i - 1}_{j - 1}" for i in (1, 2, 3) for j in (1, 2, 3)]
        + [f"sum(r_{i} * r_y) AS a_{i - 1}_3" for i in (1, 2, 3)]
    )
    from .oracle import _eliminate

    steps, solved = _eliminate(3, 4, "fs_gram", "", "fsj")
    return f"""{IV_SQL},
keyed AS (SELECT *, log_price AS r_y, log_price_iv AS r_1, unit_nine AS r_2, cent_nine AS r_3 FROM priced),
{demeaned},
fs_gram AS (SELECT {g} FROM {last}),
{", ".join(steps)},
hats AS (SELECT d.*, log_price - (r_y - a_0_3 * r_1 - a_1_3 * r_2 - a_2_3 * r_3) AS log_price_hat FROM {last} AS d, {solved}),
second AS (SELECT *, log_price_hat * unit_nine AS log_price_unit_hat, log_price_hat * cent_nine AS log_price_cent_hat FROM hats)"""


def _register_second(name, x):
    @query(name, ols_sql(_hat_sql(), "second", "log_quantity", x, [[d] for d in IV_FE], cluster=["store_id"]))
    def model(spark, sf_dir):
        fit = fe_ols(with_price_hat(spark, sf_dir), "log_quantity", x, (), IV_FE, ["store_id"], vcov="cluster")
        return tidy(fit)


for _name, _x in SECOND.items():
    _register_second(_name, _x)

FULL = SECOND["two_stage_full"]


@query(
    "two_stage_by_chain",
    ols_sql(_hat_sql(), "second", "log_quantity", FULL, [[d] for d in IV_FE], by=["kjedeid"], cluster=["store_id"], sweeps=16),
)
def two_stage_by_chain(spark, sf_dir):
    rows = with_price_hat(spark, sf_dir)
    fit = fe_ols(rows, "log_quantity", FULL, (), IV_FE, ["store_id"], ["kjedeid"], "cluster")
    return tidy(fit, "kjedeid")


def _pivot_sql():
    """Entries as printed: estimate, stars by the ratio to the error, the error in parentheses."""
    models = {
        name: ols_sql(_hat_sql(), "second", "log_quantity", x, [[d] for d in IV_FE], cluster=["store_id"])
        for name, x in SECOND.items()
    }
    united = "\nUNION ALL\n".join(f"SELECT '{name}' AS model, * FROM ({sql})" for name, sql in models.items())
    star = "".join(f" WHEN abs(estimate / std_error) >= {level} THEN '{mark}'" for level, mark in STAR_LEVELS)
    entry = f"printf('%.3f', estimate) || CASE{star} ELSE '' END || chr(10) || printf('(%.3f)', std_error)"
    columns = ", ".join(f"max(entry) FILTER (model = '{name}') AS {name}" for name in SECOND)
    return f"SELECT term, {columns} FROM (SELECT model, term, {entry} AS entry FROM ({united}) WHERE estimate IS NOT NULL) GROUP BY term"


@query("model_table_pivot", _pivot_sql())
def model_table_pivot(spark, sf_dir):
    """Two-stage models of all second stages side by side, from one panel."""
    rows = with_price_hat(spark, sf_dir)
    panel, _ = make_panel(rows, ["log_quantity", *FULL], (), IV_FE, ["store_id"])
    tables = []
    for name, x in SECOND.items():
        fit = fit_panel(panel, "log_quantity", x, "cluster", ["store_id"])
        tables.append(fit.tidy().withColumn("model", F.lit(name)))
    united = tables[0]
    for table in tables[1:]:
        united = united.unionByName(table)
    return model_table(united, "model", list(SECOND))


# The chains that the cells' stores belong to, as columns of the printed table.
CHAINS = [f"chain_{i}" for i in range(5)]


def _chain_pivot_sql():
    sql = ols_sql(_hat_sql(), "second", "log_quantity", FULL, [[d] for d in IV_FE], by=["kjedeid"], cluster=["store_id"], sweeps=16)
    star = "".join(f" WHEN abs(estimate / std_error) >= {level} THEN '{mark}'" for level, mark in STAR_LEVELS)
    entry = f"printf('%.3f', estimate) || CASE{star} ELSE '' END || chr(10) || printf('(%.3f)', std_error)"
    columns = ", ".join(f"max(entry) FILTER (kjedeid = '{name}') AS \"{name}\"" for name in CHAINS)
    return f"SELECT term, {columns} FROM (SELECT kjedeid, term, {entry} AS entry FROM ({sql}) WHERE estimate IS NOT NULL) GROUP BY term"


@query("elasticity_by_chain_table", _chain_pivot_sql())
def elasticity_by_chain_table(spark, sf_dir):
    """The full second stage of every chain side by side, with stars."""
    fit = fe_ols(with_price_hat(spark, sf_dir), "log_quantity", FULL, (), IV_FE, ["store_id"], ["kjedeid"], "cluster")
    table = fit.tidy()
    # A fitted chain that is not listed gets its column after the others.
    further = table.select("kjedeid").where(~F.col("kjedeid").isin(CHAINS)).distinct().collect()
    return model_table(table, "kjedeid", [*CHAINS, *sorted(r[0] for r in further)])


def _grid_sql():
    x = FULL
    ols = ols_sql(_hat_sql(), "second", "log_quantity", x, [[d] for d in IV_FE], sweeps=20, exact=True)
    b = ", ".join(f"max(estimate) FILTER (term = '{c}') AS b{i}" for i, c in enumerate(x))
    return f"""WITH est AS ({ols}), b AS (SELECT {b} FROM est),
grid AS (SELECT i * (100.0::DOUBLE / 9999) AS price FROM range(1, 10000) AS t(i)),
ended AS (SELECT price, {ENDING_TESTS["B"][0]} AS unit_nine, {ENDING_TESTS["B"][1]} AS cent_nine FROM grid WHERE price > 38 AND price < 42)
SELECT price, unit_nine, cent_nine,
  round(b0 * ln(price) + b1 * unit_nine::INT + b2 * ln(price) * unit_nine::INT + b3 * cent_nine::INT + b4 * ln(price) * cent_nine::INT + {NUDGE!r}, 4) + 0.0 AS log_q_hat
FROM ended, b"""


@query("predict_grid", _grid_sql())
def predict_grid(spark, sf_dir):
    """Predicted log quantity on an even price grid from the full second stage."""
    fit = fe_ols(with_price_hat(spark, sf_dir), "log_quantity", FULL, (), IV_FE)
    grid = with_endings(price_grid(spark), "price", "B").withColumn("log_price_hat", F.ln("price"))
    pairs = {
        "log_price_unit_hat": ("log_price_hat", "unit_nine"),
        "log_price_cent_hat": ("log_price_hat", "cent_nine"),
    }
    scored = score_rows(with_interactions(grid, pairs), fit.coefficients(), "log_q_hat")
    window = scored.where((F.col("price") > 38) & (F.col("price") < 42))
    return window.select("price", "unit_nine", "cent_nine", _r4("log_q_hat").alias("log_q_hat"))


# --- levels that hang together ------------------------------------------------------

# Products and stores by week: no row links two weeks, so every week is a component of its own at least.
BY_WEEK = [["sku_gtin", "week"], ["store_id", "week"]]
PARTS_SQL = f"""{CELLS_LOG_SQL},
links AS (SELECT DISTINCT week, sku_gtin, store_id FROM cells_log),
pairs AS (SELECT DISTINCT week, a.sku_gtin AS one, b.sku_gtin AS other FROM links AS a JOIN links AS b USING (week, store_id)),
reached AS (
  SELECT week, one, one AS other FROM pairs UNION
  SELECT r.week, r.one, p.other FROM reached AS r JOIN pairs AS p ON r.week = p.week AND r.other = p.one),
parts AS (SELECT week, one AS sku_gtin, min(other) AS part FROM reached GROUP BY week, one)"""


def _recursive(sql):
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_EXACT = "count(DISTINCT (sku_gtin, week)) + count(DISTINCT (store_id, week)) - (SELECT count(DISTINCT (week, part)) FROM parts)"


@query("fe_exact_rank", _recursive(ols_sql(PARTS_SQL, "cells_log", "log_quantity", ["log_price", "unit_nine"], BY_WEEK, sweeps=120, fe_levels=_EXACT)))
def fe_exact_rank(spark, sf_dir):
    """Degrees of freedom from the connected components of products and stores by week."""
    return tidy(fe_ols(cells_log(spark, sf_dir), "log_quantity", ["log_price", "unit_nine"], (), BY_WEEK, fe_dof="exact"))


ONE_STORE = [["store_id", "sku_gtin"], ["week"]]


def _pruned_sql(rounds=8):
    """Rows alone at a level go, again and again; the rounds are more than the test tables need."""
    parts, current = [CELLS_LOG_SQL], "cells_log"
    for k in range(rounds):
        counted = " AND ".join(f"count(*) OVER (PARTITION BY {', '.join(d)}) > 1" for d in ONE_STORE)
        parts.append(f"pruned{k} AS MATERIALIZED (SELECT * FROM {current} QUALIFY {counted})")
        current = f"pruned{k}"
    return ",\n".join(parts), current


@query("fe_without_singletons", ols_sql(*_pruned_sql(), "log_quantity", ["log_price", "unit_nine"], ONE_STORE, sweeps=40))
def fe_without_singletons(spark, sf_dir):
    """Products seen once in a store say nothing about their price there and go."""
    return tidy(fe_ols(cells_log(spark, sf_dir), "log_quantity", ["log_price", "unit_nine"], (), ONE_STORE, drop_singletons=True))


def _component_sql(sweeps=120):
    """Effects by unrolled sweeps, then the constant of the smallest norm in each component."""
    start = "at0 AS (SELECT sku_gtin, store_id, week, log_quantity AS r, 0.0::DOUBLE AS e0, 0.0::DOUBLE AS e1 FROM cells_log)"
    parts, current = [PARTS_SQL, start], "at0"
    for k in range(2 * sweeps):
        mean = f"avg(r) OVER (PARTITION BY {', '.join(BY_WEEK[k % 2])})"
        parts.append(f"at{k + 1} AS MATERIALIZED (SELECT * REPLACE (r - {mean} AS r, e{k % 2} + {mean} AS e{k % 2}) FROM {current})")
        current = f"at{k + 1}"
    return f"""WITH RECURSIVE {", ".join(parts)},
one AS (SELECT 'product' AS dimension, sku_gtin::VARCHAR AS level, week, part, any_value(e0) AS effect FROM {current} JOIN parts USING (sku_gtin, week) GROUP BY ALL),
two AS (SELECT 'store' AS dimension, store_id AS level, week, part, any_value(e1) AS effect FROM {current} JOIN parts USING (sku_gtin, week) GROUP BY ALL),
levels AS (SELECT *, -1 AS side FROM one UNION ALL SELECT *, 1 FROM two)
SELECT week, part AS component, dimension, level, {_sql_r4("effect - side * avg(side * effect) OVER (PARTITION BY week, part)")} AS effect FROM levels"""


@query("fe_component_effects", _component_sql())
def fe_component_effects(spark, sf_dir):
    """Effects of products and stores by week, comparable within the component that names its smallest product."""
    fit = fe_ols(cells_log(spark, sf_dir), "log_quantity", [], (), BY_WEEK)
    products, stores = component_effects(fit)
    names = products.groupBy("component").agg(F.min("sku_gtin").alias("part"))
    both = products.select("component", "week", F.lit("product").alias("dimension"), F.col("sku_gtin").cast("string").alias("level"), "effect").unionByName(
        stores.select("component", "week", F.lit("store").alias("dimension"), F.col("store_id").alias("level"), "effect")
    )
    return both.join(names, "component").select("week", F.col("part").alias("component"), "dimension", "level", _r4("effect").alias("effect"))


# --- effects and residuals on rows -------------------------------------------------


@query(
    "fixed_effects_one_way",
    f"""WITH {CELLS_LOG_SQL}, d AS (
  SELECT *, log_quantity - avg(log_quantity) OVER w AS ry, log_price - avg(log_price) OVER w AS rx
  FROM cells_log WINDOW w AS (PARTITION BY sku_gtin)),
b AS (SELECT sum(rx * ry) / sum(rx * rx) AS beta FROM d)
SELECT sku_gtin, {sql_r6("avg(log_quantity) - any_value(beta) * avg(log_price)")} AS effect FROM cells_log, b GROUP BY sku_gtin""",
)
def fixed_effects_one_way(spark, sf_dir):
    fit = fe_ols(cells_log(spark, sf_dir), "log_quantity", ["log_price"], (), ["sku_gtin"])
    return fixed_effects(fit, 0).select("sku_gtin", r6("effect").alias("effect"))


def _residual_sql():
    text, last = absorb_ctes("keyed", [[d] for d in IV_FE], ["ry", "rx"], 20)
    return f"""WITH {CELLS_LOG_SQL},
keyed AS (SELECT month, week, sku_gtin, store_id, ppu, log_quantity, log_quantity AS ry, log_price AS rx FROM cells_log), {text},
b AS (SELECT sum(rx * ry) / sum(rx * rx) AS beta FROM {last})
SELECT month, week, sku_gtin, store_id, ppu, {_sql_r4("log_quantity - (ry - beta * rx)")} AS fitted,
       {_sql_r4("ry - beta * rx")} AS residual FROM {last}, b"""


@query("fitted_and_residuals", _residual_sql())
def fitted_and_residuals(spark, sf_dir):
    rows = cells_log(spark, sf_dir)
    fit = fe_ols(rows, "log_quantity", ["log_price"], (), IV_FE)
    scored = with_fitted(rows, fit, "fitted", "residual")
    return scored.select(
        "month", "week", "sku_gtin", "store_id", "ppu", _r4("fitted").alias("fitted"), _r4("residual").alias("residual")
    )
