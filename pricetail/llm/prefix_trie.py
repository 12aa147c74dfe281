"""The prefix trie of conversations, rolled up by centroid decomposition.

Every distinct sequence of first turns is a node.  A prefix's identity is the
exclusive or of 128-bit hashes of its turns with their places, so the prefixes
of one conversation, however long, can be found in separate chunks.

Sums over subtrees come from a centroid decomposition of the forest of parent
edges.  A node weighs as many rows as there are conversations through it; the
weight of its whole subtree follows from one aggregate (lengths of its members
less their depth), before any roll-up.  In a component of weight W the nodes
with more than half of W below them form one path from the top, and its deepest
node is the centroid.  The centroid's subtree is added up and the total goes to
the nodes of that path; then the subtrees below the centroid and what is left
above it are components of less than half the weight, so there are as many
rounds as W has binary digits, however deep or broad the trie is.  Components
over ``COMPONENT_ROWS`` are split by joins and aggregates; the others fit a task,
which goes on in the same way in numpy, many components at once.

Odd rows: turns without a conv_id belong to none and are left out.  A null role
or text is empty, a null turn comes first, and turns of one number are ordered
by role and text; repeated rows are turns of their own.  Texts are hashed whole.
An empty table gives no node; further columns are ignored.  ``ends_sha256`` hashes
its ids as a sorted stream: a node at which very many conversations end costs one
task time, not memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.groups import join_sized_table, small_side
from ._common import body, saved

# Turns of one conversation that are handled together; longer ones are cut in chunks.
CHUNK = 4096
# Components up to this weight go to a task as they are.
COMPONENT_ROWS = 50_000
NODE = ["n1", "n2"]
PARENT = ["p1", "p2"]


# --- sequences ------------------------------------------------------------------------


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, content, chars): turns numbered from 1 in the order of their turn.

    Rows are sorted by ranges of (conversation, turn, role, text), so one
    conversation may span many tasks; places continue over the ranges' totals.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", body("role").alias("role"), body("text").alias("text"))
    # The last key only spreads rows that are equal in all others.
    turns = turns.filter("conv_id IS NOT NULL").withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "spread"]
    content = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.monotonically_increasing_id().alias("row"), content.alias("content"), F.char_length("text").cast("long").alias("chars")
    )
    ranged = saved(ranged, "turns").withColumn("range", F.shiftright("row", 33))
    sums = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("row"))
    placed = ranged.withColumn("local", local).join(sums, ["conv_id", "range"])
    return placed.select("conv_id", (F.col("local") + F.col("before")).alias("place"), "content", "chars")


def rebuilt(turns: DataFrame, template: Column, borrowed: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another one.

    ``template`` (of conv_id) names that one, ``borrowed`` how many of its turns
    are taken, at most ``most``; they replace as many of the conversation's own.
    Returns (conv_id, depth, content, chars, size) and (conv_id, size).
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select("conv_id", "n", template.alias("template"), borrowed.alias("h"))
    lengths = sizes.select(F.col("conv_id").alias("template"), F.col("n").alias("there"))
    convs = convs.join(lengths, "template", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0))))
    convs = saved(convs.withColumn("size", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "convs")
    wanted = convs.select("template").distinct()
    heads = turns.filter(F.col("place") <= most).withColumnRenamed("conv_id", "template").join(wanted, "template", "left_semi")
    first = convs.join(heads, "template").filter("place <= h").select("conv_id", F.col("place").alias("depth"), "content", "chars", "size")
    # A long conversation's turns meet their conversation chunk by chunk.
    chunk = (F.col("place") / CHUNK).cast("long")
    spread = convs.select("conv_id", "h", "m", "size", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") / CHUNK).cast("long"))).alias("chunk"))
    rest = turns.withColumn("chunk", chunk).join(spread, ["conv_id", "chunk"]).filter("place > h")
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("m")).alias("depth"), "content", "chars", "size")
    return first.unionByName(rest), convs.select("conv_id", "size")


def memberships(sequences: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, n1, n2, p1, p2, chars, size): the node of every prefix, the root's among them."""
    marks = sequences.withColumns(
        {
            "e1": F.xxhash64(F.lit(1), "depth", "content"),
            "e2": F.xxhash64("content", "depth", F.lit(2)),
            "chunk": ((F.col("depth") - 1) / CHUNK).cast("long"),
        }
    )
    so_far = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = marks.groupBy("conv_id", "chunk").agg(F.bit_xor("e1").alias("s1"), F.bit_xor("e2").alias("s2"))
    sums = sums.select("conv_id", "chunk", F.bit_xor("s1").over(earlier).alias("b1"), F.bit_xor("s2").over(earlier).alias("b2")).filter("chunk > 0")
    marks = marks.withColumns({"x1": F.bit_xor("e1").over(so_far), "x2": F.bit_xor("e2").over(so_far)})
    zero = F.lit(0).cast("long")
    marks = marks.join(sums, ["conv_id", "chunk"], "left").withColumns(
        {f"n{i}": F.col(f"x{i}").bitwiseXOR(F.coalesce(f"b{i}", zero)) for i in (1, 2)}
    )
    marks = marks.withColumns({f"p{i}": F.col(f"n{i}").bitwiseXOR(F.col(f"e{i}")) for i in (1, 2)})
    columns = ["conv_id", "depth", *NODE, *PARENT, "chars", "size"]
    none = F.lit(None).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("n1"), zero.alias("n2"), none.alias("p1"), none.alias("p2"), zero.alias("chars"), "size")
    return roots.unionByName(marks.select(*columns))


# --- roll-up --------------------------------------------------------------------------


def _split(state: DataFrame, members: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round: every component loses its centroid; returns what is left and the centroids, done."""
    top = ["c1", "c2"]
    heavy = F.col("w") * 2 > F.col("whole")
    deepest = F.max(F.when(heavy, F.struct("depth", "n1", "n2", "w"))).alias("x")
    cents = state.groupBy(*top).agg(deepest).select(*top, *[F.col(f"x.{a}").alias(f"x_{a}") for a in ("depth", "n1", "n2", "w")])
    cents = small_side(saved(cents, "centroids"))
    # The children of centroids, and through them which child each conversation passes.
    children = state.join(cents, top).filter("p1 = x_n1 AND p2 = x_n2")
    children = children.select(*NODE, F.col("w").alias("y_w"), F.col("c1").alias("k1"), F.col("c2").alias("k2"), "x_depth", F.col("n_convs").alias("_rows"))
    passed = join_sized_table(members.select(*NODE, "conv_id", "size"), saved(children, "children"), NODE).filter("y_w IS NOT NULL")
    chunks = F.explode(F.sequence((F.col("x_depth") / CHUNK).cast("long"), (F.col("size") / CHUNK).cast("long")))
    passed = passed.select("conv_id", "k1", "k2", F.col("n1").alias("y1"), F.col("n2").alias("y2"), "y_w", chunks.alias("chunk"))
    placed = state.join(cents, top).withColumn("chunk", (F.col("depth") / CHUNK).cast("long"))
    match = [F.col(f"s.{a}") == F.col(f"t.{b}") for a, b in (("conv_id", "conv_id"), ("c1", "k1"), ("c2", "k2"), ("chunk", "chunk"))]
    placed = placed.alias("s").join(passed.alias("t"), match, "left").select("s.*", "t.y1", "t.y2", "t.y_w")
    centre = (F.col("n1") == F.col("x_n1")) & (F.col("n2") == F.col("x_n2"))
    below = (F.col("depth") > F.col("x_depth")) & F.col("y_w").isNotNull()
    placed = saved(placed.withColumns({"centre": centre, "below": below}), "placed")
    sums = placed.filter("centre OR below").groupBy(*top).agg(*[F.sum(v).alias(f"sum_{v}") for v in values])
    moved = placed.join(small_side(sums), top)
    path = heavy & (F.col("depth") <= F.col("x_depth"))
    above = F.col("whole") - F.col("x_w")
    moved = moved.withColumns(
        {
            **{f"all_{v}": F.col(f"all_{v}") + F.when(path, F.col(f"sum_{v}")).otherwise(0) for v in values},
            "w": F.col("w") - F.when(path & ~F.col("centre"), F.col("x_w")).otherwise(0),
            "whole": F.when(F.col("below"), F.col("y_w")).otherwise(above),
            "c1": F.when(F.col("below"), F.col("y1")).otherwise(F.col("c1")),
            "c2": F.when(F.col("below"), F.col("y2")).otherwise(F.col("c2")),
        }
    )
    moved = saved(moved.select(*state.columns, "centre"), "split")
    return moved.filter("NOT centre").drop("centre"), moved.filter("centre").drop("centre")


def roll_up(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of ``values`` over each node's subtree; ``parent`` is -1 at the tops of the forest.

    ``weight`` is that of the whole subtree.  All components are split at once.
    """
    n = len(parent)
    every = np.arange(n)
    w = weight.copy()
    sums = [np.zeros(n, dtype="int64") for _ in values]
    comp = np.where(parent < 0, every, parent)
    while True:
        further = comp[comp]
        if (further == comp).all():
            break
        comp = further
    alive = np.ones(n, dtype=bool)
    centre = np.full(n, -1)
    while alive.any():
        live = np.flatnonzero(alive)
        path = live[2 * w[live] > w[comp[live]]]
        path = path[np.argsort(depth[path], kind="stable")]
        centre[comp[path]] = path  # the last one written is the deepest
        x = centre[comp]
        up = parent[live]
        inner = (comp[live] != live) & (x[live] != live) & (up != x[live])
        jump = every.copy()
        jump[live[inner]] = up[inner]
        while True:
            further = jump[jump]
            if (further == jump).all():
                break
            jump = further
        at = jump[live]
        below = (live != x[live]) & (parent[at] == x[live]) & (at != comp[live])
        whole = np.concatenate([live[below], live[live == x[live]]])
        for own, total in zip(values, sums):
            added = np.zeros(n, dtype="int64")
            np.add.at(added, comp[whole], own[whole])
            total[path] += added[comp[path]]
        lost = w[x[path]]
        w[path] = np.where(path == x[path], w[path], w[path] - lost)
        alive[np.unique(x[live])] = False
        comp[live[below]] = at[below]
    return sums


def _in_task(values: list[str]):
    def bucket(table: pa.Table) -> pa.Table:
        columns = {c: np.asarray(table[c].combine_chunks().fill_null(0)) for c in ("n1", "n2", "p1", "p2", "c1", "c2", "depth", "w", *values)}
        at = {key: i for i, key in enumerate(zip(columns["n1"].tolist(), columns["n2"].tolist()))}
        up = [at.get(key, -1) for key in zip(columns["p1"].tolist(), columns["p2"].tolist())]
        top = (columns["n1"] == columns["c1"]) & (columns["n2"] == columns["c2"])
        parent = np.where(top, -1, np.array(up, dtype="int64"))
        for v, total in zip(values, roll_up(parent, columns["depth"], columns["w"], [columns[v] for v in values])):
            total = total + np.asarray(table[f"all_{v}"].combine_chunks())
            table = table.set_column(table.schema.get_field_index(f"all_{v}"), f"all_{v}", pa.array(total))
        return table

    return bucket


def subtree_sums(nodes: DataFrame, members: DataFrame, values: list[str]) -> DataFrame:
    """``nodes`` with ``all_<value>`` for each value: its sum over the node and all below it.

    ``nodes`` has n1, n2, p1, p2 (null at the root), depth, conv_id (any member), n_convs and
    w, the weight of the whole subtree.
    """
    start = {f"all_{v}": F.lit(0).cast("long") for v in values}
    root = nodes.filter("p1 IS NULL").select("w").first()
    if root is None:
        return nodes.withColumns(start)
    state = nodes.withColumns({**start, "c1": F.lit(0).cast("long"), "c2": F.lit(0).cast("long"), "whole": F.lit(root["w"]).cast("long")})
    done, ready, largest = [], [], root["w"]
    while largest is not None and largest > COMPONENT_ROWS:
        ready.append(state.filter(F.col("whole") <= COMPONENT_ROWS))
        state, centres = _split(state.filter(F.col("whole") > COMPONENT_ROWS), members, values)
        done.append(centres)
        largest = state.agg(F.max("whole")).first()[0]
    small = state
    for one in ready:
        small = small.unionByName(one)
    # Whole components side by side, about as many rows a bucket as the largest component may have.
    cores = state.sparkSession.sparkContext.defaultParallelism
    buckets = max(2 * cores, -(-small.count() // COMPONENT_ROWS))
    small = small.withColumn("bucket", F.pmod(F.xxhash64("c1", "c2"), F.lit(buckets))).repartition(2 * buckets, "bucket")
    out = small.groupBy("bucket").applyInArrow(_in_task(values), small.schema).drop("bucket")
    for one in done:
        out = out.unionByName(one)
    return out.drop("c1", "c2", "whole")


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, from rows sorted by node and id."""
    node, digest, rows = None, None, []

    def flush() -> pa.RecordBatch:
        n1, n2, text = zip(*rows) if rows else ((), (), ())
        return pa.record_batch({"n1": pa.array(n1, pa.int64()), "n2": pa.array(n2, pa.int64()), "ends_sha256": pa.array(text, pa.string())})

    for batch in batches:
        n1, n2 = np.asarray(batch["n1"]), np.asarray(batch["n2"])
        ids = np.asarray(batch["conv_id"]).astype("U").tolist()
        cuts = [0, *(np.flatnonzero((n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])) + 1).tolist(), len(ids)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            joined = ",".join(ids[lo:hi]).encode()
            if (n1[lo], n2[lo]) == node:
                digest.update(b"," + joined)
            else:
                if node is not None:
                    rows.append((*node, digest.hexdigest()))
                node, digest = (n1[lo], n2[lo]), hashlib.sha256(joined)
        yield flush()
        rows.clear()
    if node is not None:
        rows.append((*node, digest.hexdigest()))
    yield flush()


def prefix_trie(members: DataFrame) -> DataFrame:
    """One row per node of the trie of :func:`memberships`, with counts and subtree sums.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (characters that sharing prefixes spares in the
    subtree) and ends_sha256 (of the ids of conversations that end here).
    """
    members = saved(members, "members")
    nodes = members.groupBy(*NODE).agg(
        *[F.min(c).alias(c) for c in ("depth", *PARENT, "chars", "conv_id")],
        F.count("*").alias("n_convs"),
        (F.sum("size") - F.count("*") * (F.min("depth") - 1)).alias("w"),
    )
    nodes = saved(nodes, "nodes")
    children = nodes.filter("p1 IS NOT NULL").groupBy(*[F.col(p).alias(n) for p, n in zip(PARENT, NODE)]).agg(F.count("*").alias("n_children"))
    nodes = saved(nodes.join(children, NODE, "left").fillna(0, ["n_children"]), "nodes")
    parents = nodes.filter("n_children > 0").select(
        *[F.col(n).alias(p) for n, p in zip(NODE, PARENT)], F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_rows")
    )
    values = {"leaf": (F.col("n_children") == 0).cast("long"), "spare": (F.col("n_convs") - 1) * F.col("chars")}
    nodes = saved(join_sized_table(nodes, parents, PARENT).withColumns(values), "nodes")
    summed = subtree_sums(nodes, members, list(values))
    ends = members.filter("depth = size").select(*NODE, "conv_id").repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")
    ends = ends.mapInArrow(_hashed_ends, "n1 long, n2 long, ends_sha256 string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return summed.join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("all_leaf").alias("n_leaves"),
        F.col("all_spare").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
