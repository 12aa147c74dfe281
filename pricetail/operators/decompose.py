"""How much of a flag's variance goes with each set of fixed effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .absorb import MAX_SWEEPS, TOLERANCE, _quoted, absorb, collapse, remove_effects

# The four steps of the standard decomposition, by the roles of the columns.
# Each step works on what the step before has left over.
STANDARD_STEPS = [
    {"chain": ["chain"], "week": ["week"], "product": ["product"]},
    {"store": ["store"]},
    {"chainXweek": ["chain", "week"], "chainXproduct": ["chain", "product"]},
    {
        "storeXproduct": ["store", "product"],
        "storeXweek": ["store", "week"],
        "productXweek": ["product", "week"],
    },
]


def decomposed_records(
    df: DataFrame,
    flag: str,
    steps: list[dict[str, list[str]]],
    tol: float = TOLERANCE,
    max_sweeps: int = MAX_SWEEPS,
) -> DataFrame:
    """One record per combination of levels; ``_v_<component>`` is an effect on it.

    Rows of one record differ in the flag only, so all steps run on records.
    """
    keys = list(dict.fromkeys(c for step in steps for dim in step.values() for c in dim))
    records = materialise(collapse(df, keys, [flag]).withColumn("residual", F.col(flag)))
    for step in steps:
        effects = absorb(records, [], list(step.values()), ["residual"], keys, tol=tol, max_sweeps=max_sweeps)
        frame, left = remove_effects(records, effects, ["residual"], keys)
        kept = [c for c in records.columns if c != "residual"]
        named = [f"`_e{i}_residual` AS `_v_{name}`" for i, name in enumerate(step)]
        records = materialise(frame.selectExpr(*_quoted(kept), *named, f"{left['residual']} AS residual"))
    return records


def variance_decomposition(
    df: DataFrame,
    flag: str,
    steps: list[dict[str, list[str]]],
    tol: float = TOLERANCE,
    max_sweeps: int = MAX_SWEEPS,
) -> DataFrame:
    """Sample variance over rows of each component and its share of the flag's.

    Effects that several dimensions could carry go to the dimension that comes
    first: the sweeps start from zero and follow the listed order.
    """
    records = decomposed_records(df, flag, steps, tol, max_sweeps)
    names = [name for step in steps for name in step]
    within = f"_w_{flag}__{flag}"

    def variance(column: str, inside: str) -> str:
        squares = f"sum(n * `{column}` * `{column}`) + {inside}"
        return f"({squares} - pow(sum(n * `{column}`), 2) / sum(n)) / (sum(n) - 1)"

    parts = [f"{variance(f'_v_{c}', '0')} AS `_v_{c}`" for c in names]
    inside = f"sum(`{within}`)"
    parts += [f"{variance('residual', inside)} AS _v_residual", f"{variance(flag, inside)} AS _total"]
    wide = records.agg(*map(F.expr, parts))
    labels = [*names, "residual"]
    stacked = ", ".join(f"'{c}', `_v_{c}`" for c in labels)
    long = wide.selectExpr("_total", f"stack({len(labels)}, {stacked}) AS (component, variance)")
    return long.selectExpr("component", "variance", "variance / _total AS share")
