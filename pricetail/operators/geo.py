"""Local competition from store coordinates, and matching of store tables.

Distances are planar, in the unit of the coordinates (metres).  Neighbour
searches descend a tree of cells, cut where the stores are.  A store looks at whole cells first
and only at the stores of cells that can still matter, so a dense town is
never compared pair by pair with everything around it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .groups import first_by

# Each axis of a cell is cut at these quantiles of its places, found to one part in ACCURACY.
CUTS = [0.25, 0.5, 0.75]
ACCURACY = 1000
# Cells with at most this many places are compared place by place.
LEAF_PLACES = 32
# Stores looking for their nearest one do so in blocks: cells with at most this many times as many places.
BLOCK_LEAVES = 4
# A level with at most this many cells is broadcast (about 100 bytes a cell).
BROADCAST_CELLS = 50_000


def dedupe_addresses(stores: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One store per address; the first id wins."""
    return first_by(stores, ["adresse", "postnr", "poststed"], order or ["id"])


def two_key_join(
    left: DataFrame,
    right: DataFrame,
    left_key: Column,
    id_key: Column,
    alt_key: Column,
    take: list[str],
) -> DataFrame:
    """Match on a main key, else on an alternative key, and say which matched.

    Columns in ``take`` prefer the main match.  Each side of the match is
    reduced to one row per key first, so no row of ``left`` is duplicated.
    ``matched_on`` is ``id_int``, ``gln_clean`` or NULL.
    """

    def unique(key: Column, prefix: str) -> DataFrame:
        named = [F.col(c).alias(f"{prefix}{c}") for c in take]
        keyed = right.select(key.alias("_key"), *named).where(F.col("_key").isNotNull())
        return first_by(keyed, ["_key"], [f"{prefix}{c}" for c in take])

    by_id = unique(id_key, "_i_").withColumnRenamed("_key", "_key_i")
    by_alt = unique(alt_key, "_a_").withColumnRenamed("_key", "_key_a")
    joined = (
        left.withColumn("_left", left_key)
        .join(by_id, F.col("_left") == F.col("_key_i"), "left")
        .join(by_alt, F.col("_left") == F.col("_key_a"), "left")
    )
    taken = [F.coalesce(f"_i_{c}", f"_a_{c}").alias(c) for c in take]
    matched = F.when(F.col("_key_i").isNotNull(), F.lit("id_int")).when(
        F.col("_key_a").isNotNull(), F.lit("gln_clean")
    )
    kept = [c for c in left.columns if c not in take]
    return joined.select(*kept, *taken, matched.alias("matched_on"))


def match_coverage(left: DataFrame, right: DataFrame, key: str, right_key: str, present: str) -> DataFrame:
    """How many rows found a partner with a value, and how many did not."""
    partner = right.select(F.col(right_key).alias(key), F.col(present).alias("_present"))
    joined = left.join(partner, key, "left")
    return joined.agg(
        F.count_if(F.col("_present").isNull()).alias("without_match"),
        F.count_if(F.col("_present").isNotNull()).alias("with_match"),
    )


def unmatched(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    return left.join(right.select(F.col(right_key).alias(key)), key, "left_anti")


def with_municipality(
    df: DataFrame, stores: DataFrame, key: str, store_key: str, default: str = "0301"
) -> DataFrame:
    """Municipality of each row's store; an unknown one gets the default."""
    lookup = stores.select(F.col(store_key).alias(key), "kommune_id").distinct()
    joined = df.join(lookup, key, "left")
    return joined.withColumn("kommune_id", F.coalesce("kommune_id", F.lit(default)))


def local_monopoly(df: DataFrame, distance: str, radii_km: list[float] = (2, 5, 10)) -> DataFrame:
    """Flags telling that the nearest competitor is farther away than a radius."""
    flags = {f"local_monopoly_{r:g}km": F.col(distance) > r * 1000 for r in radii_km}
    return df.withColumns(flags)


class _Tree:
    """Distinct places in nested cells, cut where the places are.

    Level 0 is a single cell around all places.  A cell with more than ``leaf`` (LEAF_PLACES)
    places is cut at the quartiles of its own places, along both axes, into up to
    sixteen cells of the next level; smaller cells end there.  A cell's id is the
    id of its parent and one more digit.  Cuts follow the places, so a dense town
    next to an empty country costs no extra levels, and as no point holds more than
    a few places every cut makes progress: there is no limit to the depth.

    Each level has one row per cell: its id, its parent's id, the box around its
    places, their number and weight, and the smallest and largest ``label``.  With
    ``extra`` columns there is one such tree per value of these.
    """

    def __init__(self, places: DataFrame, extra: list[str], leaf: int | None = None):
        self.extra = extra
        self.leaf = leaf or LEAF_PLACES
        self.places: list[DataFrame] = []
        self.cells: list[DataFrame] = []
        inside = materialise(places.withColumn("cell", F.lit("")))
        while True:
            self.places.append(inside)
            cells = materialise(
                inside.groupBy(*extra, "cell").agg(
                    F.min("px").alias("bx0"),
                    F.max("px").alias("bx1"),
                    F.min("py").alias("by0"),
                    F.max("py").alias("by1"),
                    F.count(F.lit(1)).alias("places"),
                    F.sum("weight").alias("weight"),
                    F.min("label").alias("label_min"),
                    F.max("label").alias("label_max"),
                    F.percentile_approx("px", CUTS, ACCURACY).alias("cut_x"),
                    F.percentile_approx("py", CUTS, ACCURACY).alias("cut_y"),
                )
            )
            cells = cells.withColumn("parent", F.expr("substr(cell, 1, length(cell) - 1)"))
            size = cells.agg(F.count(F.lit(1)).alias("rows"), F.max("places").alias("most")).first()
            if size["rows"] <= BROADCAST_CELLS:
                cells = F.broadcast(cells)
            self.cells.append(cells.drop("cut_x", "cut_y"))
            if (size["most"] or 0) <= self.leaf:
                break
            cuts = cells.where(F.col("places") > self.leaf).select(*extra, "cell", "cut_x", "cut_y")
            part = _part("px", "cut_x") * (len(CUTS) + 1) + _part("py", "cut_y")
            inside = inside.join(cuts, [*extra, "cell"]).withColumn("cell", F.concat("cell", F.hex(part)))
            inside = materialise(inside.drop("cut_x", "cut_y"))
        self.depth = len(self.cells) - 1

    def step(self, frontier: DataFrame, level: int) -> DataFrame:
        """Replace each frontier cell by its occupied children (level 0: by itself)."""
        if level == 0:
            return frontier.join(self.cells[0].drop("parent"), ["cell", *self.extra])
        children = self.cells[level].withColumnRenamed("cell", "child")
        parents = frontier.withColumnRenamed("cell", "parent")
        joined = parents.join(children, ["parent", *self.extra])
        return joined.withColumnRenamed("child", "cell").drop("parent")

    def blocks(self) -> DataFrame:
        """All places with the cell that they end in."""
        ended = [p.join(c.where(F.col("places") <= self.leaf).select(*self.extra, "cell"), [*self.extra, "cell"]) for p, c in zip(self.places, self.cells)]
        return reduce(DataFrame.unionByName, ended)

    def open(self, frontier: DataFrame, level: int) -> DataFrame:
        """Replace frontier cells by the places in them."""
        return frontier.join(self.places[level], ["cell", *self.extra])


def _part(value: str, cuts: str) -> Column:
    """How many of the cuts lie below a value."""
    return reduce(lambda a, b: a + b, [(F.col(value) > F.col(cuts)[k]).cast("long") for k in range(len(CUTS))])


def _on_the_plane(x: Column, y: Column) -> Column:
    """Both coordinates are there and finite."""
    return (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))


def _near(x: Column, y: Column) -> Column:
    """Squared distance from a point to the closest point of a box."""
    dx = F.greatest(F.col("bx0") - x, x - F.col("bx1"), F.lit(0.0))
    dy = F.greatest(F.col("by0") - y, y - F.col("by1"), F.lit(0.0))
    return dx * dx + dy * dy


def _far(x: Column, y: Column) -> Column:
    """Squared distance from a point to the farthest corner of a box."""
    dx = F.greatest(x - F.col("bx0"), F.col("bx1") - x)
    dy = F.greatest(y - F.col("by0"), F.col("by1") - y)
    return dx * dx + dy * dy


# Bounds are compared with a relative slack so that rounding in the box
# arithmetic can never drop a cell that holds the answer.
_SLACK = 1 + 1e-12


def nearest_store(
    stores: DataFrame,
    key: str,
    x: str,
    y: str,
    differ_on: str | None = None,
    exclude: str = "self",
    name: str = "min_distance",
) -> DataFrame:
    """Distance from each store to its nearest other store.

    ``differ_on`` restricts the others to stores with another value there
    (chain, owner).  Without it the others are all stores but the store itself
    (``exclude="self"``) or all stores at another point (``exclude="zero"``).
    Stores without finite coordinates, without the compared value or without any
    other store are returned with a NULL distance.
    """
    if exclude not in ("self", "zero"):
        raise ValueError(f"unknown exclude {exclude!r}")
    if exclude == "zero" and differ_on is not None:
        raise ValueError("exclude='zero' compares points and takes no differ_on")
    if exclude == "zero":
        label = F.concat_ws(" ", F.col(x).cast("string"), F.col(y).cast("string"))
    else:
        label = F.col(differ_on or key).cast("string")
    located = stores.select(
        F.col(key).alias("_id"),
        F.col(x).cast("double").alias("qx"),
        F.col(y).cast("double").alias("qy"),
        label.alias("own"),
    ).where(_on_the_plane(F.col("qx"), F.col("qy")) & F.col("own").isNotNull())
    located = materialise(located)
    # A point with two labels is at distance zero for all its own stores.  To others it
    # shows its smallest and largest label: one of them differs from any label they have.
    points = materialise(
        located.groupBy("qx", "qy").agg(
            F.min("own").alias("low"), F.max("own").alias("high"), F.count(F.lit(1)).alias("weight")
        )
    )
    places = points.select(
        F.col("qx").alias("px"), F.col("qy").alias("py"),
        F.explode(F.array_distinct(F.array("low", "high"))).alias("label"), "weight",
        (F.col("low") == F.col("high")).alias("alone"),
    )
    shared = points.where(F.col("low") != F.col("high")).select("qx", "qy")
    tree = _Tree(places, [], BLOCK_LEAVES * LEAF_PLACES)
    blocks = materialise(tree.blocks().select("cell", "px", "py", "label", "alone"))
    qx, qy = F.col("qx"), F.col("qy")
    who = ["qx", "qy", "own"]
    dx, dy = F.col("px") - qx, F.col("py") - qy
    squared = F.when(F.col("label") != F.col("own"), dx * dx + dy * dy)
    # Stores at one point with one label share their answer.  They look in their own block first.
    queries = blocks.where("alone").select(F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("label").alias("own"), "cell")
    near = queries.join(blocks, "cell").groupBy(*who, F.col("cell").alias("block")).agg(F.min(squared).alias("d2"))
    near = materialise(near)
    pairs = _blocks_in_reach(tree, near.withColumn("d2", F.coalesce("d2", F.lit(float("inf")))))
    # Then each store looks at the other blocks: the nearest place is at most as far as the
    # far corner of the best one; blocks that start beyond it cannot hold it.
    other = (F.col("label_min") != F.col("own")) | (F.col("label_max") != F.col("own"))
    reach = F.coalesce("d2", F.lit(float("inf"))) * _SLACK
    seen = near.join(pairs, "block").where(other & (_near(qx, qy) <= reach))
    seen = materialise(seen.select(*who, "cell", reach.alias("reach"), _near(qx, qy).alias("lo"), _far(qx, qy).alias("hi")))
    bound = seen.groupBy(*who).agg((F.min("hi") * _SLACK).alias("best"))
    opened = seen.join(bound, who).where(F.col("lo") <= F.least("reach", "best")).select(*who, "cell")
    across = opened.join(blocks, "cell").select(*who, squared.alias("d2"))
    best = near.select(*who, "d2").unionByName(across).groupBy(*who).agg(F.sqrt(F.min("d2")).alias(name))
    found = located.join(best, who).select(F.col("_id").alias(key), name)
    together = located.join(shared, ["qx", "qy"]).select(F.col("_id").alias(key), F.lit(0.0).alias(name))
    # Kept, as callers go on from here with further searches that would run this one again.
    found = materialise(found.unionByName(together))
    return stores.join(found, key, "left")


def _blocks_in_reach(tree: _Tree, near: DataFrame) -> DataFrame:
    """Which other blocks may hold a nearer place for some store of a block.

    ``near`` has the stores with their ``block`` and the squared distance ``d2`` that they
    found in it.  Blocks descend the tree as wholes: a cell stays if it starts within
    the farthest such distance, and within the far corner of the best cell that holds
    another label for every store of the block.
    """
    frontier = near.groupBy("block").agg(
        F.min("qx").alias("qx0"), F.max("qx").alias("qx1"), F.min("qy").alias("qy0"), F.max("qy").alias("qy1"),
        F.min("own").alias("own_min"), F.max("own").alias("own_max"), (F.max("d2") * _SLACK).alias("ub"),
    )
    whose = frontier.columns[:-1]
    frontier = materialise(frontier).withColumn("cell", F.lit(""))
    gap_x = F.greatest(F.col("bx0") - F.col("qx1"), F.col("qx0") - F.col("bx1"), F.lit(0.0))
    gap_y = F.greatest(F.col("by0") - F.col("qy1"), F.col("qy0") - F.col("by1"), F.lit(0.0))
    span_x = F.greatest(F.col("bx1") - F.col("qx0"), F.col("qx1") - F.col("bx0"))
    span_y = F.greatest(F.col("by1") - F.col("qy0"), F.col("qy1") - F.col("by0"))
    one_label = F.col("own_min") == F.col("own_max")
    differs = (F.col("label_min") != F.col("own_min")) | (F.col("label_max") != F.col("own_min"))
    for_all = (F.col("label_min") != F.col("label_max")) | (one_label & differs)
    box = ["bx0", "bx1", "by0", "by1", "label_min", "label_max"]
    pairs = []
    for level in range(tree.depth + 1):
        stepped = tree.step(frontier, level).where(~one_label | differs)
        stepped = stepped.withColumns({"lo": gap_x * gap_x + gap_y * gap_y, "hi": F.when(for_all, span_x * span_x + span_y * span_y)})
        stepped = materialise(stepped.where(F.col("lo") <= F.col("ub")).select(*whose, "cell", "places", *box, "ub", "lo", "hi"))
        bound = stepped.groupBy("block").agg((F.min("hi") * _SLACK).alias("new_ub"))
        kept = stepped.join(bound, "block").withColumn("ub", F.least("ub", "new_ub")).where(F.col("lo") <= F.col("ub"))
        leaf = F.col("places") <= tree.leaf
        pairs.append(kept.where(leaf & (F.col("cell") != F.col("block"))).select("block", "cell", *box))
        frontier = kept.where(~leaf).select(*whose, "cell", "ub")
    return reduce(DataFrame.unionByName, pairs)


def _count_within(queries: DataFrame, places: DataFrame, extra: list[str]) -> DataFrame:
    """Total weight of the places within radius ``r`` of each query point.

    ``extra`` columns must agree between query and place.  A cell that lies
    wholly inside the circle adds its weight; one that lies outside is dropped;
    only cells cut by the circle are opened.
    """
    tree = _Tree(places, extra)
    who = ["qx", "qy", "r", *extra]
    qx, qy, r = F.col("qx"), F.col("qy"), F.col("r")
    dx, dy = F.col("px") - qx, F.col("py") - qy
    # The same test as on a plain pair of stores: root of squares against r.
    close = F.sqrt(dx * dx + dy * dy) <= r
    inside = _far(qx, qy) * _SLACK <= r * r
    outside = _near(qx, qy) > r * r * _SLACK
    frontier = queries.select(*who).distinct().withColumn("cell", F.lit(""))
    sums = []
    for level in range(tree.depth + 1):
        stepped = tree.step(frontier, level).where(~outside)
        stepped = stepped.select(*who, "cell", "places", "weight", inside.alias("inside"))
        if level < tree.depth:
            stepped = materialise(stepped)
        sums.append(stepped.where("inside").select(*who, "weight"))
        cut = stepped.where(~F.col("inside"))
        leaf = F.col("places") <= LEAF_PLACES
        pairs = tree.open(cut.where(leaf).select(*who, "cell"), level)
        sums.append(pairs.where(close).select(*who, "weight"))
        frontier = cut.where(~leaf).select(*who, "cell")
    return reduce(DataFrame.unionByName, sums).groupBy(*who).agg(F.sum("weight").alias("found"))


def competitors_within(
    stores: DataFrame,
    key: str,
    x: str,
    y: str,
    chain: str,
    radii_km: list[float] = (2, 5, 10),
) -> DataFrame:
    """Number of other-chain stores within each radius of every store.

    Counted as all stores in the circle minus those of the own chain.  A store
    without chain counts none, one without finite coordinates has NULL; neither is
    counted by others.
    """
    located = stores.select(
        F.col(key).alias("_id"),
        F.col(x).cast("double").alias("qx"),
        F.col(y).cast("double").alias("qy"),
        F.col(chain).alias("_chain"),
    ).where(_on_the_plane(F.col("qx"), F.col("qy")) & F.col("_chain").isNotNull())
    located = materialise(located)
    radii = F.explode(F.array(*[F.lit(float(k) * 1000) for k in radii_km])).alias("r")
    queries = located.select("qx", "qy", "_chain", radii)
    place = [F.col("qx").alias("px"), F.col("qy").alias("py")]
    one = F.count(F.lit(1)).alias("weight")
    label = F.lit("").alias("label")
    everyone = located.groupBy(*place).agg(one).withColumn("label", label)
    own = located.groupBy(*place, "_chain").agg(one).withColumn("label", label)
    total = _count_within(queries, everyone, []).withColumnRenamed("found", "_all")
    same = _count_within(queries, own, ["_chain"]).withColumnRenamed("found", "_same")
    counted = (
        queries.distinct()
        .join(total, ["qx", "qy", "r"], "left")
        .join(same, ["qx", "qy", "r", "_chain"], "left")
    )
    others = F.coalesce("_all", F.lit(0)) - F.coalesce("_same", F.lit(0))
    wide = counted.groupBy("qx", "qy", "_chain").agg(
        *[
            F.max(F.when(F.col("r") == float(k) * 1000, others)).alias(f"competitors_within_{k:g}km")
            for k in radii_km
        ]
    )
    found = located.join(wide, ["qx", "qy", "_chain"]).select(
        F.col("_id").alias(key), *[F.col(f"`{c}`") for c in wide.columns if c.startswith("competitors")]
    )
    found = materialise(found)
    names = [c for c in found.columns if c != key]
    placed = _on_the_plane(F.col(x).cast("double"), F.col(y).cast("double"))
    counts = {c: F.when(placed, F.coalesce(F.col(f"`{c}`"), F.lit(0))) for c in names}
    return stores.join(found, key, "left").withColumns(counts)
