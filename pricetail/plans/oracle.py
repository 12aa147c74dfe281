"""SQL text for fixed-effect models, written independently of the DataFrame code.

Fixed effects are removed by unrolled sweeps of ``avg() OVER``; the normal
equations are solved by Gauss-Jordan elimination, one step per common table.
"""

from __future__ import annotations

from .registry import sql_r6


def absorb_ctes(source: str, dims: list[list[str]], columns: list[str], sweeps: int, by: list[str] = (), prefix: str = "ab") -> tuple[str, str]:
    """Common tables that demean ``columns`` of ``source``; returns them and the last name."""
    parts, current, step = [], source, 0
    if len(dims) == 1:
        sweeps = 1
    for _ in range(sweeps):
        for dim in dims:
            keys = ", ".join([*by, *[c for c in dim if c not in by]])
            name = f"{prefix}{step}"
            less = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {keys}) AS {c}" for c in columns)
            parts.append(f"{name} AS MATERIALIZED (SELECT * REPLACE ({less}) FROM {current})")
            current, step = name, step + 1
    return ",\n".join(parts), current


def _eliminate(size: int, width: int, start: str, keys: str, prefix: str) -> tuple[list[str], str]:
    """Gauss-Jordan steps on columns a_i_j (i < size, j < width)."""
    parts, current = [], start
    for p in range(size):
        name = f"{prefix}{p}"
        cells = []
        for i in range(size):
            for j in range(width):
                if i == p:
                    cells.append(f"a_{p}_{j} / a_{p}_{p} AS a_{i}_{j}")
                else:
                    cells.append(f"a_{i}_{j} - a_{i}_{p} * a_{p}_{j} / a_{p}_{p} AS a_{i}_{j}")
        parts.append(f"{name} AS MATERIALIZED (SELECT {keys}{', '.join(cells)} FROM {current})")
        current = name
    return parts, current


def ols_sql(
    source_ctes: str,
    source: str,
    y: str,
    x: list[str],
    dims: list[list[str]] = (),
    by: list[str] = (),
    cluster: list[str] = (),
    sweeps: int = 10,
    fe_dof: str = "all",
    instruments: list[str] = (),
    terms: dict[str, str] | None = None,
    exact: bool = False,
    fe_levels: str | None = None,
) -> str:
    """Estimates and errors of one model as rows (by..., term, estimate, std_error, n_obs).

    Estimates are rounded to six digits unless ``exact``.  ``fe_levels`` is SQL for the
    number of absorbed parameters.

    With ``instruments`` the model is just identified and every regressor is
    replaced in the moment conditions by the instrument in the same place.
    Without dimensions the caller supplies a constant column among ``x``.
    """
    z = list(instruments) or list(x)
    columns = list(dict.fromkeys([y, *x, *z]))
    k = len(x)
    by_list = "".join(f"{c}, " for c in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    parts = [source_ctes]
    data = source
    levels = "0"
    if dims:
        text, data = absorb_ctes(source, dims, columns, sweeps, list(by))
        parts.append(text)
        if fe_levels is not None:
            levels = fe_levels
        elif fe_dof == "all":
            counts = " + ".join(f"count(DISTINCT ({', '.join(d)}))" for d in dims)
            levels = f"{counts} - {len(dims) - 1}"
    # Z'X, then the identity, then Z'y.
    cells = []
    for i in range(k):
        cells += [f"sum({z[i]} * {x[j]}) AS a_{i}_{j}" for j in range(k)]
        cells += [f"{1.0 if i == j else 0.0}::DOUBLE AS a_{i}_{k + j}" for j in range(k)]
        cells.append(f"sum({z[i]} * {y}) AS a_{i}_{2 * k}")
    parts.append(
        f"gram AS (SELECT {by_list}{', '.join(cells)}, count(*) AS n_obs, {levels} AS fe_levels FROM {data} {group})"
    )
    steps, last = _eliminate(k, 2 * k + 1, "gram", f"{by_list}n_obs, fe_levels, ", "gj")
    parts += steps
    beta = [f"s.a_{i}_{2 * k}" for i in range(k)]
    match = " AND ".join(f"d.{c} = s.{c}" for c in by) or "true"
    resid = " - ".join([f"d.{y}", *[f"{b} * d.{c}" for b, c in zip(beta, x)]])
    d_by = "".join(f"d.{c}, " for c in by)
    d_group = f"GROUP BY {', '.join(f'd.{c}' for c in by)}" if by else ""
    inv = [[f"s.a_{i}_{k + j}" for j in range(k)] for i in range(k)]
    if not cluster:
        parts.append(
            f"err AS (SELECT {d_by}sum(({resid}) * ({resid})) AS ssr FROM {data} AS d JOIN {last} AS s ON {match} {d_group})"
        )
        variance = [f"m.ssr / (s.n_obs - {k} - s.fe_levels) * {inv[i][i]}" for i in range(k)]
        meat_from = f"{last} AS s JOIN err AS m ON " + (" AND ".join(f"m.{c} = s.{c}" for c in by) or "true")
    else:
        sets = [[c] for c in cluster] + ([list(cluster)] if len(cluster) == 2 else [])
        joins = []
        for m, columns_of in enumerate(sets):
            keys = ", ".join(f"d.{c}" for c in [*by, *columns_of])
            scores = ", ".join(f"sum(d.{z[i]} * ({resid})) AS s_{i}" for i in range(k))
            parts.append(f"score{m} AS (SELECT {keys}, {scores} FROM {data} AS d JOIN {last} AS s ON {match} GROUP BY {keys})")
            outer = ", ".join(f"sum(s_{i} * s_{j}) AS m_{i}_{j}" for i in range(k) for j in range(k))
            parts.append(f"meat{m} AS (SELECT {by_list}{outer}, count(*) AS g FROM score{m} {group})")
            joins.append(f"JOIN meat{m} AS m{m} ON " + (" AND ".join(f"m{m}.{c} = s.{c}" for c in by) or "true"))
        fewest = f"least({', '.join(f'm{m}.g' for m in range(len(cluster)))})" if len(cluster) > 1 else "m0.g"
        factor = f"({fewest} / ({fewest} - 1.0::DOUBLE) * (s.n_obs - 1.0::DOUBLE) / (s.n_obs - {k} - s.fe_levels))"
        variance = []
        for t in range(k):
            total = []
            for m in range(len(sets)):
                terms_of = [f"{inv[t][a]} * m{m}.m_{a}_{b} * {inv[t][b]}" for a in range(k) for b in range(k)]
                total.append(("- " if m == 2 else "+ ") + "(" + " + ".join(terms_of) + ")")
            variance.append(f"{factor} * ({' '.join(total)})")
        meat_from = f"{last} AS s " + " ".join(joins)
    s_by = "".join(f"s.{c} AS {c}, " for c in by)
    names = terms or {}
    # A regressor without variation of its own has no estimate.
    rows = [
        f"SELECT {s_by}'{names.get(x[i], x[i])}' AS term, {beta[i] if exact else sql_r6(beta[i])} AS estimate, "
        f"{sql_r6(f'sqrt({variance[i]})')} AS std_error, s.n_obs AS n_obs FROM {meat_from}"
        for i in range(k)
    ]
    return "WITH " + ",\n".join(parts) + "\n" + "\nUNION ALL\n".join(rows)
