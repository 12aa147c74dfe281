"""Linear models with absorbed fixed effects, clustered errors and instruments.

The cluster computes sums of products.  A fit without groups solves its one small
system on the driver; with groups, each is solved in the task that holds its sums,
and coefficients stay a table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import format_estimate
from .absorb import MAX_SWEEPS, TOLERANCE, Panel, build_panel
from ..session import materialise
from .groups import join_sized_table

INTERCEPT = "(Intercept)"
# Up to this many columns the products are plain SQL sums.
SQL_COLUMNS = 12
# Sums of products that a task holds for its groups before it passes them on: 32 MB.
HELD_PRODUCTS = 4 << 20
# A factor with more levels than this should be absorbed instead.
MAX_FACTOR_LEVELS = 400
# A regressor is dropped when less than this share of its variation is its own.
PIVOT_TOLERANCE = 1e-9


@dataclass(frozen=True)
class Factor:
    """A categorical regressor: one dummy per level but the reference.

    Without ``reference`` the smallest level is left out.  ``levels`` may be
    declared to save the pass that looks them up.
    """

    column: str
    reference: object = None
    levels: tuple = ()

    def term(self, level) -> str:
        return f"{self.column}[{level:g}]" if isinstance(level, float) else f"{self.column}[{level}]"


@dataclass
class GroupFit:
    """Solved coefficients of one group."""

    terms: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    n_obs: int
    dropped: list[str]

    def rows(self) -> list[tuple]:
        """Term, estimate, error, t, p and interval; a dropped term has NULLs."""
        out = []
        for i, term in enumerate(self.terms):
            estimate = float(self.beta[i])
            variance = float(self.covariance[i, i])
            if not variance >= 0:
                # No error can be given: not 0, which would claim certainty.
                out.append((term, estimate, *[None] * 5))
                continue
            se = math.sqrt(variance)
            t = estimate / se if se > 0 else None
            p = math.erfc(abs(t) / math.sqrt(2)) if t is not None else None
            out.append((term, estimate, se, t, p, estimate - 1.96 * se, estimate + 1.96 * se))
        return out + [(term, *[None] * 6) for term in self.dropped]


ENTRY = "term string, estimate double, std_error double, t double, p double, ci_low double, ci_high double"


@dataclass
class Fit:
    """A fitted model: one set of coefficients, or a table with one row per group.

    ``solutions`` (with groups only) has the group's key, ``beta`` in the order of
    ``terms`` (0 for a dropped term), ``n_obs`` and ``entries`` as in :meth:`tidy`.
    Groups are solved where they are; only the result of a fit without groups is
    on the driver.
    """

    spark: SparkSession
    panel: Panel
    y: str
    terms: list[str]
    groups: list[GroupFit]
    factors: list[Factor] = field(default_factory=list)
    solutions: DataFrame | None = None
    hidden: tuple[str, ...] = ()

    def tidy(self) -> DataFrame:
        """Term, estimate, standard error, t, p and 95 per cent interval.

        p and the interval use the normal distribution.  A term that was
        dropped as collinear is listed with NULL values.
        """
        if self.solutions is not None:
            by = [F.col(c) for c in self.panel.by]
            entries = self.solutions.select(*by, F.explode("entries").alias("e"), "n_obs").select(*by, "e.*", "n_obs")
            return entries.where(~F.col("term").isin(list(self.hidden))) if self.hidden else entries
        rows = [(*row, g.n_obs) for g in self.groups for row in g.rows()]
        return self.spark.createDataFrame(rows, f"{ENTRY}, n_obs long")

    def without_intercept(self) -> Fit:
        """The same fit with the intercept left out of its terms."""
        groups = []
        for g in self.groups:
            keep = [i for i, term in enumerate(g.terms) if term != INTERCEPT]
            cov = g.covariance[np.ix_(keep, keep)]
            groups.append(GroupFit([g.terms[i] for i in keep], g.beta[keep], cov, g.n_obs, g.dropped))
        if self.solutions is not None:
            return replace(self, hidden=(INTERCEPT,))
        return replace(self, terms=[t for t in self.terms if t != INTERCEPT], groups=groups)

    def coefficients(self, key: tuple = ()) -> dict[str, float]:
        """Coefficients of the terms kept, of one group where there are groups."""
        if self.solutions is not None:
            wanted = reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(self.panel.by, key, strict=True)])
            row = self.solutions.where(wanted).select("entries").first()
            if row is None:
                raise KeyError(key)
            return {e.term: e.estimate for e in row.entries if e.estimate is not None}
        if key or not self.groups:
            raise KeyError(key)
        [group] = self.groups
        return dict(zip(group.terms, (float(b) for b in group.beta)))


# --- sums of products -------------------------------------------------------


def _pairs(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def _wide_sums(df: DataFrame, by: list[str], columns: list[str], weight: str, inner: dict[tuple[int, int], str]) -> DataFrame:
    """Summed products of many columns: tasks sum outer products, then tasks add up.

    ``inner`` names columns that are added to the product of a pair as they are.
    """
    names, keys, size = list(columns), list(by), len(columns)
    i, j = np.triu_indices(size)
    place = {pair: k for k, pair in enumerate(zip(i.tolist(), j.tolist()))}

    def partial(batches):
        total: dict[tuple, np.ndarray] = {}

        def flushed():
            for key, (sums, rows) in total.items():
                frame = pd.DataFrame({"k": np.arange(-1, len(sums)), "value": np.concatenate([[rows], sums])})
                for name, part in zip(keys, key):
                    frame[name] = part
                yield frame[[*keys, "k", "value"]]
            total.clear()

        for batch in batches:
            groups = batch.groupby(keys, dropna=False, sort=False) if keys else [((), batch)]
            for key, part in groups:
                x, w = part[names].to_numpy(dtype="float64"), part[[weight]].to_numpy(dtype="float64")
                sums = (x.T @ (x * w))[i, j]
                for pair, column in inner.items():
                    sums[place[pair]] += part[column].sum()
                key = key if isinstance(key, tuple) else (key,)
                before = total.get(key, (0.0, 0.0))
                total[key] = before[0] + sums, before[1] + w.sum()
                if len(total) * len(i) > HELD_PRODUCTS:
                    yield from flushed()
        yield from flushed()

    types = {f.name: f for f in df.schema.fields}
    schema = T.StructType([types[c] for c in keys] + [T.StructField("k", T.IntegerType()), T.StructField("value", T.DoubleType())])
    needed = [F.col(c) for c in dict.fromkeys([*keys, *names, weight, *inner.values()])]
    parts = df.select(*needed).mapInPandas(partial, schema)
    sums = parts.groupBy(*keys, "k").agg(F.sum("value").alias("value"))
    listed = F.array_sort(F.collect_list(F.struct("k", "value")))
    whole = sums.groupBy(*keys).agg(F.transform(listed, lambda s: s["value"]).alias("all"))
    return whole.where(F.size("all") > 0).select(*keys, F.col("all")[0].cast("long").alias("n_obs"), F.slice("all", 2, len(i)).alias("gram"))


def panel_gram(panel: Panel, columns: list[str]) -> DataFrame:
    """Per group the row count and, as ``gram``, the summed products of demeaned variables (i <= j)."""
    pairs = {(i, j): (columns[i], columns[j]) for i, j in _pairs(len(columns))}
    if len(columns) <= SQL_COLUMNS:
        sums = F.array(*[F.expr(f"sum({panel.product(a, b)})") for a, b in pairs.values()])
        return panel.table.groupBy(*panel.by).agg(F.sum("n").alias("n_obs"), sums.alias("gram")).where("n_obs > 0")
    inner = {ij: f"_w_{a}__{b}" for ij, (a, b) in pairs.items() if f"_w_{a}__{b}" in panel.table.columns}
    return _wide_sums(panel.table, panel.by, columns, "n", inner)


def score_gram(scores: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Per ``by`` the number of clusters and, as ``gram``, the summed outer products of their scores."""
    if len(columns) <= SQL_COLUMNS:
        sums = F.array(*[F.expr(f"sum({columns[i]} * {columns[j]})") for i, j in _pairs(len(columns))])
        return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n_obs"), sums.alias("gram"))
    return _wide_sums(scores.withColumn("_one", F.lit(1.0)), by, columns, "_one", {})


def _square(upper: list[float], size: int) -> np.ndarray:
    """A symmetric matrix from its upper triangle, row by row."""
    out = np.zeros((size, size))
    i, j = np.triu_indices(size)
    out[i, j] = out[j, i] = [v or 0.0 for v in upper]
    return out


# --- algebra on the small matrices of one group ----------------------------------


def independent_columns(gram: np.ndarray) -> list[int]:
    """Indices of columns that are not linear combinations of earlier ones."""
    kept: list[int] = []
    for j in range(gram.shape[0]):
        own = gram[j, j]
        if own <= 0:
            continue
        left = own
        if kept:
            block = gram[np.ix_(kept, kept)]
            left = own - gram[j, kept] @ np.linalg.solve(block, gram[kept, j])
        if left > PIVOT_TOLERANCE * own:
            kept.append(j)
    return kept


@dataclass(frozen=True)
class _System:
    """What the groups' equations have in common; it travels to the tasks that solve them."""

    columns: list[str]
    y: str
    x: list[str]
    z: list[str]
    n_clusters: int
    cluster_df: str

    def solve(self, upper: list[float], n_obs: int, absorbed: int) -> dict:
        """Coefficients of one group and what its covariance needs."""
        at = {c: i for i, c in enumerate(self.columns)}
        gram = _square(upper, len(self.columns))
        xi, zi = [at[c] for c in self.x], [at[c] for c in self.z]
        z_kept = [zi[k] for k in independent_columns(gram[np.ix_(zi, zi)])]
        zz, zx = gram[np.ix_(z_kept, z_kept)], gram[np.ix_(z_kept, xi)]
        first_stage = np.linalg.solve(zz, zx) if z_kept else np.zeros((0, len(xi)))
        hat = zx.T @ first_stage
        x_kept = independent_columns(hat)
        pi = first_stage[:, x_kept]
        hat = hat[np.ix_(x_kept, x_kept)]
        inverse = np.linalg.inv(hat) if x_kept else np.zeros((0, 0))
        beta = inverse @ (pi.T @ gram[z_kept, at[self.y]])
        used = [xi[k] for k in x_kept]
        ssr = gram[at[self.y], at[self.y]] - 2 * beta @ gram[used, at[self.y]] + beta @ gram[np.ix_(used, used)] @ beta
        free = int(n_obs - (len(x_kept) + absorbed))
        sigma2 = max(ssr, 0.0) / free if free > 0 else float("nan")
        z_at = [self.z.index(self.columns[k]) for k in z_kept]
        return {"kept": x_kept, "beta": beta, "inverse": inverse, "z_kept": z_at, "pi": pi, "free": free, "sigma2": sigma2, "n_obs": int(n_obs)}

    def finish(self, solved: dict, meats: dict[int, tuple[list[float], int]] | None, means: dict[str, float] | None) -> GroupFit:
        """The group's fit: covariance from the clusters' scores where there are any, intercept put back."""
        inverse, pi, free, n_obs = solved["inverse"], solved["pi"], solved["free"], solved["n_obs"]
        terms = [self.x[k] for k in solved["kept"]]
        fit = GroupFit(terms, solved["beta"], inverse * solved["sigma2"], n_obs, [c for c in self.x if c not in terms])
        if meats is not None:
            index = solved["z_kept"]
            fewest = min(meats[m][1] for m in range(self.n_clusters))
            total = np.zeros_like(inverse)
            for m, (upper, count) in meats.items():
                matrix = _square(upper, len(self.z))
                count = fewest if self.cluster_df == "min" else count
                factor = count / (count - 1) * (n_obs - 1) / free if count > 1 and free > 0 else float("nan")
                core = pi.T @ matrix[np.ix_(index, index)] @ pi
                total += (-1 if m == 2 else 1) * factor * (inverse @ core @ inverse)
            fit.covariance = _not_negative(total) if self.n_clusters == 2 else total
        if means is not None and INTERCEPT in terms:
            # From centred variables back to the given ones: only the intercept and its errors change.
            k = terms.index(INTERCEPT)
            turn = np.eye(len(terms))
            turn[k, :] = [1.0 if t == INTERCEPT else -means[t] for t in terms]
            fit.beta = turn @ fit.beta
            fit.beta[k] += means[self.y]
            fit.covariance = turn @ fit.covariance @ turn.T
        return fit


def _absorbed_levels(panel: Panel, clusters: list[str], fe_dof: str) -> int | DataFrame:
    """Parameters taken up by the absorbed dimensions: a number, or a table by group."""
    if fe_dof == "exact" and panel.dims:
        from .levels import absorbed_rank

        ranks = absorbed_rank(panel)
        return ranks if panel.by else int(ranks.first()["levels"] or 0)
    dims = [] if fe_dof in ("none", "exact") else [
        effects for dim, effects in zip(panel.dims, panel.effects) if not (fe_dof == "nested" and dim in [[c] for c in clusters])
    ]
    less = max(len(dims) - 1, 0)
    if not panel.by:
        return sum(e.levels for e in dims) - less
    if not dims:
        return 0
    counted = [e.table.groupBy(*panel.by).agg(F.count(F.lit(1)).alias("levels")) for e in dims]
    return reduce(DataFrame.unionByName, counted).groupBy(*panel.by).agg((F.sum("levels") - less).alias("levels"))


# --- models ------------------------------------------------------------------


def _factor_dummies(df: DataFrame, factors: list[Factor]) -> dict[str, Column]:
    dummies: dict[str, Column] = {}
    for factor in factors:
        levels = list(factor.levels)
        if not levels:
            distinct = df.select(factor.column).where(F.col(factor.column).isNotNull()).distinct()
            levels = sorted(r[0] for r in distinct.limit(MAX_FACTOR_LEVELS + 1).collect())
        if len(levels) > MAX_FACTOR_LEVELS:
            raise ValueError(f"{factor.column} has too many levels for dummies; absorb it")
        if not levels:
            continue
        if factor.reference is not None and factor.reference not in levels:
            raise ValueError(f"{factor.reference!r} is none of the levels of {factor.column}")
        reference = levels[0] if factor.reference is None else factor.reference
        for level in levels:
            if level != reference:
                test = F.col(factor.column) == F.lit(level)
                dummies[factor.term(level)] = F.when(test, 1.0).otherwise(0.0)
    return dummies


def _as_dims(absorb) -> list[list[str]]:
    return [[d] if isinstance(d, str) else list(d) for d in absorb]


def make_panel(
    df: DataFrame,
    variables: list[str],
    factors: list[Factor] | tuple = (),
    absorb=(),
    cluster: list[str] | tuple = (),
    by: list[str] | tuple = (),
    tol: float = TOLERANCE,
    max_sweeps: int = MAX_SWEEPS,
    drop_singletons: bool = False,
) -> tuple[Panel, list[str]]:
    """The demeaned records several models can share, and the dummy terms."""
    dims = _as_dims(absorb)
    dummies = _factor_dummies(df, list(factors))
    derived = dict(dummies)
    if not dims:
        derived[INTERCEPT] = F.lit(1.0)
    panel = build_panel(
        df,
        list(dict.fromkeys(variables)),
        derived,
        [f.column for f in factors],
        dims,
        list(by),
        list(cluster),
        tol,
        max_sweeps,
        (INTERCEPT,),
        drop_singletons,
    )
    for factor in factors:
        if factor.levels:
            # The records hold every level once for each combination: far fewer than rows.
            other = panel.table.where(~F.col(factor.column).isin(list(factor.levels))).select(factor.column).limit(1).collect()
            if other:
                raise ValueError(f"{other[0][0]!r} is none of the declared levels of {factor.column}")
    return panel, list(dummies)


def fit_panel(
    panel: Panel,
    y: str,
    x: list[str],
    vcov: str = "iid",
    cluster: list[str] | tuple = (),
    instruments: list[str] | tuple = (),
    endogenous: list[str] | tuple = (),
    fe_dof: str = "all",
    cluster_df: str = "min",
) -> Fit:
    """Least squares, or two-stage least squares, on demeaned records.

    With instruments, ``endogenous`` names the regressors of ``x`` they replace
    in the first stage; residuals use the original regressors.

    ``vcov`` is ``"iid"`` or ``"cluster"`` (one or two ``cluster`` columns).
    The cluster factor is G/(G-1) * (N-1)/(N-K); for two clusterings the
    variances add up minus that of their intersection, with the smaller G for
    all three unless ``cluster_df="own"``.  K counts regressors and absorbed
    levels (``fe_dof="all"``: all but one of each further dimension; ``"exact"``:
    the rank of their dummies), leaves out dimensions that are themselves a
    cluster (``"nested"``) or counts regressors only (``"none"``).
    """
    if vcov not in ("iid", "cluster") or (vcov == "cluster" and len(cluster) not in (1, 2)):
        raise ValueError("vcov is 'iid', or 'cluster' with one or two cluster columns")
    if fe_dof not in ("all", "exact", "nested", "none") or cluster_df not in ("min", "own"):
        raise ValueError("unknown degrees-of-freedom rule")
    if instruments and len(instruments) < len(endogenous):
        raise ValueError("fewer instruments than endogenous regressors")
    x = list(x) if panel.dims else [*x, INTERCEPT]
    z = [*instruments, *[c for c in x if c not in endogenous]] if instruments else x
    clusters = list(cluster) if vcov == "cluster" else []
    system = _System(list(dict.fromkeys([y, *x, *z])), y, x, z, len(clusters), cluster_df)
    fit = Fit(panel.table.sparkSession, panel, y, x, [])
    gram = panel_gram(panel, system.columns)
    absorbed = _absorbed_levels(panel, list(cluster), fe_dof)
    if panel.by:
        return replace(fit, solutions=_solved_groups(panel, system, gram, absorbed, clusters))
    row = gram.first()
    if row is None or not row["n_obs"]:
        return fit
    solved = system.solve(row["gram"], row["n_obs"], absorbed)
    meats = None
    if clusters:
        aligned = np.zeros(len(x))
        aligned[solved["kept"]] = solved["beta"]
        scores = _cluster_scores(panel, panel.table, [f"({v!r}D)" for v in aligned.tolist()], system, clusters)
        meats = {r["_set"]: (r["gram"], r["n_obs"]) for r in scores.collect()}
    means = {c.removeprefix("_m_"): v for c, v in panel.means.first().asDict().items()} if panel.means is not None else None
    return replace(fit, groups=[system.finish(solved, meats, means)])


def _cluster_scores(panel: Panel, table: DataFrame, beta: list[str], system: _System, clusters: list[str]) -> DataFrame:
    """(by..., _set, n_obs, gram): products of the scores of each clustering, with two also of their intersection.

    The records are read once: scores of the finest clusters add up to the others'.
    """

    def score(column: str) -> str:
        fitted = [f"{b} * {panel.product(column, regressor)}" for b, regressor in zip(beta, system.x)]
        return " - ".join([panel.product(column, system.y), *fitted])

    names = [f"_s_{i}" for i in range(len(system.z))]
    own = [c for c in clusters if c not in panel.by]
    sums = [f"sum({score(c)}) AS {s}" for c, s in zip(system.z, names)]
    finest = table.groupBy(*panel.by, *own).agg(*map(F.expr, sums))
    if len(clusters) == 1:
        return score_gram(finest.withColumn("_set", F.lit(0)), [*panel.by, "_set"], names)
    sets = [[*panel.by, *[c for c in columns if c not in panel.by]] for columns in ([clusters[0]], [clusters[1]], clusters)]
    totals = [F.sum(s).alias(s) for s in names]
    if len({tuple(s) for s in sets}) == 3:
        # A bit of the grouping's number is set for each column left out.
        left_out = [sum(1 << (len(own) - 1 - i) for i, c in enumerate(own) if c not in s) for s in sets]
        which = F.create_map(*[F.lit(v) for pair in zip(left_out, range(3)) for v in pair])
        grouped = finest.groupingSets([[F.col(c) for c in s] for s in sets], *panel.by, *own).agg(*totals, F.grouping_id().alias("_id"))
        grouped = grouped.withColumn("_set", which[F.col("_id").cast("int")])
    else:
        parts = [finest.groupBy(*s).agg(*totals).withColumn("_set", F.lit(m)) for m, s in enumerate(sets)]
        grouped = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return score_gram(grouped, [*panel.by, "_set"], names)


def _solved_groups(panel: Panel, system: _System, gram: DataFrame, absorbed: int | DataFrame, clusters: list[str]) -> DataFrame:
    """One row per group, solved in the task that holds the group's sums."""
    by, keys = panel.by, [F.col(c) for c in panel.by]
    types = {f.name: f for f in panel.table.schema.fields}
    key_fields = [types[c] for c in by]
    if isinstance(absorbed, int):
        gram = gram.withColumn("levels", F.lit(absorbed))
    else:
        gram = gram.join(absorbed, by, "left").fillna(0, ["levels"])

    def solve(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                found = system.solve(row.gram, row.n_obs, row.levels)
                aligned = np.zeros(len(system.x))
                aligned[found["kept"]] = found["beta"]
                flat = {k: np.ravel(found[k]).tolist() for k in ("inverse", "pi")}
                out.append((*row[: len(by)], aligned.tolist(), found["kept"], flat["inverse"], found["z_kept"], flat["pi"], found["free"], found["sigma2"], found["n_obs"]))
            yield pd.DataFrame(out, columns=[*by, "beta", "kept", "inverse", "z_kept", "pi", "free", "sigma2", "n_obs"])

    fields = T._parse_datatype_string(
        "beta array<double>, kept array<int>, inverse array<double>, z_kept array<int>, pi array<double>, free long, sigma2 double, n_obs long"
    ).fields
    solved = materialise(gram.select(*keys, "gram", "n_obs", "levels").mapInPandas(solve, T.StructType(key_fields + fields)))
    whole = solved.withColumn("meats", F.lit(None).cast("array<struct<_set:int,n_obs:long,gram:array<double>>>"))
    if clusters:
        # Records of a large group are spread: the group's row count decides.
        coefficients = solved.select(*keys, *[F.col("beta")[i].alias(f"_b_{i}") for i in range(len(system.x))], F.col("n_obs").alias("_rows"))
        table = join_sized_table(panel.table, coefficients, by)
        scores = _cluster_scores(panel, table, [f"_b_{i}" for i in range(len(system.x))], system, clusters)
        meats = scores.groupBy(*by).agg(F.collect_list(F.struct("_set", "n_obs", "gram")).alias("meats"))
        whole = solved.join(meats, by, "left")
    centred = panel.centred if panel.means is not None else []
    if centred:
        whole = whole.join(panel.means.select(*keys, F.array(*[f"_m_{c}" for c in centred]).alias("means")), by, "left")

    def finish(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                k, kz = len(row.kept), len(row.z_kept)
                found = {"kept": list(row.kept), "beta": np.asarray(row.beta)[list(row.kept)], "z_kept": list(row.z_kept)}
                found |= {"inverse": np.reshape(row.inverse, (k, k)), "pi": np.reshape(row.pi, (kz, k)), "free": row.free, "sigma2": row.sigma2, "n_obs": row.n_obs}
                meats = {m["_set"]: (m["gram"], m["n_obs"]) for m in row.meats} if row.meats is not None else None
                means = dict(zip(centred, row.means)) if centred else None
                fit = system.finish(found, meats, means)
                aligned = dict(zip(fit.terms, fit.beta.tolist()))
                entries = [dict(zip(entry_names, values)) for values in fit.rows()]
                out.append((*row[: len(by)], [aligned.get(t, 0.0) for t in system.x], entries, fit.n_obs))
            yield pd.DataFrame(out, columns=[*by, "beta", "entries", "n_obs"])

    entry_names = [part.split()[0] for part in ENTRY.split(", ")]
    struct = ENTRY.replace(" string", ":string").replace(" double", ":double")
    fields = T._parse_datatype_string(f"beta array<double>, entries array<struct<{struct}>>, n_obs long").fields
    return materialise(whole.mapInPandas(finish, T.StructType(key_fields + fields)))


def _not_negative(matrix: np.ndarray) -> np.ndarray:
    """The matrix with negative eigenvalues set to zero; a two-way covariance may have some."""
    if not np.isfinite(matrix).all():
        return matrix
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    if not len(values) or values[0] >= 0 or not np.isfinite(values).all():
        return matrix
    return (vectors * np.maximum(values, 0.0)) @ vectors.T


def fe_ols(
    df: DataFrame,
    y: str,
    x: list[str],
    factors: list[Factor] | tuple = (),
    absorb=(),
    cluster: list[str] | tuple = (),
    by: list[str] | tuple = (),
    vcov: str = "iid",
    fe_dof: str = "all",
    cluster_df: str = "min",
    tol: float = TOLERANCE,
    max_sweeps: int = MAX_SWEEPS,
    drop_singletons: bool = False,
) -> Fit:
    """Least squares of ``y`` on ``x`` and factors with absorbed fixed effects.

    ``by`` fits the same model in every group at once.  Without absorbed
    dimensions an intercept is added.  ``drop_singletons`` leaves rows out that
    are alone at an absorbed level.
    """
    clusters = list(cluster) if vcov == "cluster" else []
    panel, dummies = make_panel(df, [y, *x], factors, absorb, clusters, by, tol, max_sweeps, drop_singletons)
    fit = fit_panel(panel, y, [*x, *dummies], vcov, clusters, fe_dof=fe_dof, cluster_df=cluster_df)
    fit.factors = list(factors)
    return fit


def iv_2sls(
    df: DataFrame,
    y: str,
    endogenous: list[str],
    instruments: list[str],
    exogenous: list[str] | tuple = (),
    absorb=(),
    cluster: list[str] | tuple = (),
    by: list[str] | tuple = (),
    vcov: str = "iid",
    fe_dof: str = "all",
    cluster_df: str = "min",
    tol: float = TOLERANCE,
    max_sweeps: int = MAX_SWEEPS,
    drop_singletons: bool = False,
) -> Fit:
    """Two-stage least squares with absorbed fixed effects."""
    clusters = list(cluster) if vcov == "cluster" else []
    x = [*endogenous, *exogenous]
    panel, _ = make_panel(df, [y, *x, *instruments], (), absorb, clusters, by, tol, max_sweeps, drop_singletons)
    return fit_panel(panel, y, x, vcov, clusters, instruments, endogenous, fe_dof, cluster_df)


# --- what a fit says about rows and levels ------------------------------------


def _with_coefficients(df: DataFrame, fit: Fit) -> tuple[DataFrame, dict[str, Column], list[str]]:
    """The frame with each term's coefficient in the row's group, and the columns added for it.

    Groups come as a table that is joined on their key; a term that a group
    dropped counts zero.  Without groups the coefficients are literals.
    """
    by = fit.panel.by
    if not by:
        values = fit.coefficients() if fit.groups else {}
        none = None if not fit.groups else 0.0
        return df, {t: F.lit(values.get(t, none)).cast("double") for t in fit.terms}, []
    names = {t: f"_coefficient_{i}" for i, t in enumerate(fit.terms)}
    picked = [F.col("beta")[i].alias(n) for i, n in enumerate(names.values())]
    table = fit.solutions.select(*[F.col(c) for c in by], *picked, F.col("n_obs").alias("_rows"))
    return join_sized_table(df, table, by), {t: F.col(n) for t, n in names.items()}, list(names.values())


def fixed_effects(fit: Fit, dim: int) -> DataFrame:
    """Effect of every level of one absorbed dimension, given the coefficients.

    Dimensions share constants between them; the split is the one reached by
    sweeping from zero in the listed order.
    """
    effects = fit.panel.effects[dim]
    table, values, _ = _with_coefficients(effects.table, fit)
    total = F.col(fit.y)
    for term in fit.terms:
        total = total - values[term] * F.col(f"`{term}`")
    return table.select(*effects.keys, total.alias("effect"), F.col("_records").alias("_rows"))


def with_fitted(df: DataFrame, fit: Fit, fitted: str | None = None, residual: str | None = None) -> DataFrame:
    """Put the fitted value (fixed effects included) or the residual on rows."""
    dummies = _factor_dummies(df, [f for f in fit.factors])
    total = F.lit(0.0)
    df, values, names = _with_coefficients(df, fit)
    for term in fit.terms:
        value = dummies.get(term, F.lit(1.0) if term == INTERCEPT else F.col(f"`{term}`").cast("double"))
        total = total + values[term] * value
    for d, effects in enumerate(fit.panel.effects):
        name = f"_effect_{d}"
        table = fixed_effects(fit, d).withColumnRenamed("effect", name)
        if effects.small:
            df = df.join(F.broadcast(table.drop("_rows")), effects.keys, "left")
        else:
            df = join_sized_table(df, table, effects.keys)
        names.append(name)
        total = total + F.col(name)
    out = {}
    if fitted:
        out[fitted] = total
    if residual:
        out[residual] = F.col(fit.y).cast("double") - total
    return df.withColumns(out).drop(*names)


def score_rows(df: DataFrame, coefficients: dict[str, float], name: str = "prediction") -> DataFrame:
    """Sum of coefficient times column, for example on a grid of prices."""
    total = F.lit(0.0)
    for term, value in coefficients.items():
        total = total + F.lit(value) * F.col(f"`{term}`").cast("double")
    return df.withColumn(name, total)


def with_interactions(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Products of column pairs; flags count as 0 and 1."""
    return df.withColumns({k: F.col(a).cast("double") * F.col(b).cast("double") for k, (a, b) in pairs.items()})


def model_table(tidy: DataFrame, model: str, models: list[str]) -> DataFrame:
    """One row per term, one column per model, entries with stars and errors."""
    entry = format_estimate(F.col("estimate"), F.col("std_error"))
    known = tidy.where(F.col("estimate").isNotNull()).withColumn("entry", entry)
    return known.groupBy("term").pivot(model, models).agg(F.first("entry"))
