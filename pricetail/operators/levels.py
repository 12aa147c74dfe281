"""Which fixed-effect levels hang together, and how many of them count.

Two absorbed dimensions form a graph: a level of one is linked to a level of the
other when a row has both.  Effects are comparable within a connected component
only, and each component has one level too many.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialise
from .absorb import Panel, _quoted, absorb, remove_effects
from .groups import join_sized_table
from .regress import Fit, fixed_effects, panel_gram

# Levels of further dimensions whose rank is found from their matrix.
RANKED_LEVELS = 400
RANK_TOLERANCE = 1e-7


def connected(links: DataFrame) -> DataFrame:
    """(node, part) from links (a, b) of whole numbers: the smallest number each node is connected to.

    Stars are contracted in turn: the larger neighbours of every node move to its
    smallest neighbour, then the smaller ones and the node itself do.  There are
    never more links than at first, and the rounds grow with the logarithm of the
    nodes.  A node with very many links is spread over tasks.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    pairs, before = materialise(pairs), None
    while True:
        state = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low")), F.sum(F.col("low").cast("decimal(38,0)"))).first())
        if state == before:
            return pairs.select(F.col("high").alias("node"), F.col("low").alias("part")).unionByName(
                pairs.select(F.col("low").alias("node"), F.col("low").alias("part")).distinct()
            )
        before = state
        sides = pairs.select(F.col("high").alias("node"), F.col("low").alias("next")).unionByName(pairs.select(F.col("low").alias("node"), F.col("high").alias("next")))
        least = sides.groupBy("node").agg(F.least(F.min("next"), F.first("node")).alias("least"), F.count("*").alias("_rows"))
        outer = join_sized_table(sides.where("next > node"), least, ["node"])
        outer = materialise(outer.select(F.col("next").alias("high"), F.col("least").alias("low")).distinct())
        least = outer.groupBy("high").agg(F.min("low").alias("least"), F.count("*").alias("_rows"))
        inner = join_sized_table(outer, least, ["high"])
        moved = inner.where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
        new = materialise(inner.select("high", F.col("least").alias("low")).unionByName(moved).distinct())
        discard(pairs), discard(outer)
        pairs = new


def linked_levels(records: DataFrame, by: list[str], first: list[str], second: list[str]) -> tuple[DataFrame, DataFrame]:
    """Levels of two dimensions with ``component``, a number that linked levels share.

    Levels are numbered, not hashed.  Levels of different groups are never linked.
    """
    tables = []
    for side, dim in enumerate((first, second)):
        keys = [*by, *[c for c in dim if c not in by]]
        levels = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        tables.append(materialise(levels.withColumn("_id", F.monotonically_increasing_id() * 2 + side)))
    one, other = ([c for c in t.columns if c not in ("_rows", "_id")] for t in tables)
    links = records.select(*dict.fromkeys([*one, *other])).distinct()
    for table, keys, name in ((tables[0], one, "_one"), (tables[1], other, "_other")):
        links = join_sized_table(links, table.withColumnRenamed("_id", name), keys)
    parts = materialise(connected(links.select(F.col("_one").alias("a"), F.col("_other").alias("b"))))
    found = [t.join(parts.withColumnsRenamed({"node": "_id", "part": "component"}), "_id").drop("_id", "_rows") for t in tables]
    return found[0], found[1]


def without_singletons(records: DataFrame, dims: list[list[str]], weight: str = "n") -> DataFrame:
    """Records without rows that are alone at a level, again until every level has two rows.

    Such a row says nothing about the regressors.  A record goes only if it is one row.
    """
    current = records
    while True:
        # A level with one row has one record, so no key here has more than one.
        alone = [current.groupBy(*dim).agg(F.sum(weight).alias("_n")).where("_n = 1").drop("_n") for dim in dims]
        left = reduce(lambda df, one: df.join(one, one.columns, "left_anti"), alone, current)
        left = materialise(left)
        if left.count() == current.count():
            return left
        if current is not records:
            discard(current)
        current = left


def _rank_of_rest(panel: Panel, base: list[int], rest: list[int]) -> DataFrame:
    """By group, the rank that the dimensions ``rest`` add to the dimensions ``base``."""
    dims = [panel.dims[d] for d in rest]
    levels = []
    for dim in dims:
        found = panel.table.select(*dim).distinct().limit(RANKED_LEVELS + 1).collect()
        levels += [(dim, row) for row in found]
    if len(levels) > RANKED_LEVELS:
        raise ValueError(f"an exact count takes {RANKED_LEVELS} levels at most beside the two largest dimensions")
    dummies = {}
    for k, (dim, row) in enumerate(levels):
        test = reduce(lambda a, b: a & b, [F.col(c) == F.lit(row[c]) for c in dim])
        dummies[f"_level_{k}"] = F.when(test, 1.0).otherwise(0.0)
    records = materialise(panel.table.select(*panel.keys, "n").withColumns(dummies))
    names = list(dummies)
    base_dims = [panel.dims[d] for d in base]
    effects = absorb(records, panel.by, base_dims, names, panel.keys)
    frame, left = remove_effects(records, effects, names, panel.keys)
    table = materialise(frame.selectExpr(*_quoted(panel.keys), "n", *[f"{left[c]} AS `{c}`" for c in names]))
    sizes = records.groupBy(*panel.by).agg(F.array(*[F.expr(f"sum(n * `{c}`)") for c in names]).alias("rows"))
    gram = panel_gram(Panel(table, panel.by, base_dims, names, [], panel.keys, effects), names)
    by, size = panel.by, len(names)
    whole = gram.select(*by, "gram").withColumn("_one", F.lit(1)).join(sizes.withColumn("_one", F.lit(1)), [*by, "_one"])

    def ranks(batches):
        i, j = np.triu_indices(size)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                matrix = np.zeros((size, size))
                matrix[i, j] = matrix[j, i] = row.gram
                scale = np.sqrt(np.maximum(np.asarray(row.rows, dtype="float64"), 1.0))
                out.append((*row[: len(by)], int(np.linalg.matrix_rank(matrix / np.outer(scale, scale), RANK_TOLERANCE, hermitian=True))))
            yield pd.DataFrame(out, columns=[*by, "levels"])

    types = {f.name: f for f in panel.table.schema.fields}
    schema = T.StructType([types[c] for c in by] + [T.StructField("levels", T.LongType())])
    return whole.select(*by, "gram", "rows").mapInPandas(ranks, schema)


def absorbed_rank(panel: Panel) -> DataFrame:
    """(by..., levels): the exact rank of the absorbed dimensions' dummies.

    The two largest dimensions have as many as their levels less the connected
    components of their graph; what further, smaller ones add is the rank of
    their dummies after the two are absorbed.
    """
    order = sorted(range(len(panel.dims)), key=lambda d: (-panel.effects[d].levels, d))
    counted = [panel.effects[d].table.groupBy(*panel.by).agg(F.count(F.lit(1)).alias("levels")) for d in order[:2]]
    if len(order) > 1:
        one, _ = linked_levels(panel.table, panel.by, panel.dims[order[0]], panel.dims[order[1]])
        counted.append(one.groupBy(*panel.by).agg((-F.count_distinct("component")).alias("levels")))
    if len(order) > 2:
        counted.append(_rank_of_rest(panel, order[:2], order[2:]))
    return reduce(DataFrame.unionByName, counted).groupBy(*panel.by).agg(F.sum("levels").alias("levels"))


def component_effects(fit: Fit, first: int = 0, second: int = 1) -> tuple[DataFrame, DataFrame]:
    """Effects of two absorbed dimensions with their component, of the smallest norm in each.

    One constant a component can move from one dimension to the other; it is set
    so that the sum of squared effects of the component's levels is smallest.
    """
    panel = fit.panel
    parts = linked_levels(panel.table, panel.by, panel.dims[first], panel.dims[second])
    found = []
    for d, part in zip((first, second), parts):
        keys = panel.effects[d].keys
        found.append(materialise(fixed_effects(fit, d).select(*keys, "effect").join(part, keys)))
    signed = [t.select("component", (F.col("effect") * sign).alias("e")) for t, sign in zip(found, (-1, 1))]
    sums = signed[0].unionByName(signed[1]).groupBy("component").agg(F.avg("e").alias("_shift"))
    # Components as hot as the data is connected: a table of levels, split by their number.
    out = []
    for table, sign in zip(found, (1, -1)):
        sizes = table.groupBy("component").agg(F.count(F.lit(1)).alias("_rows"))
        moved = join_sized_table(table, sums.join(sizes, "component"), ["component"])
        out.append(moved.withColumn("effect", F.col("effect") + sign * F.col("_shift")).drop("_shift"))
    return out[0], out[1]
