"""Connected components by hooking and shortcutting, in joins and partial aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, part): every node of the links (a, b) with the smallest node it is connected to.

    Alternates two steps until nothing changes: each node's larger neighbours
    move to its smallest neighbour, then each node's smaller neighbours do.  The
    links stay as many as the nodes at most or shrink, so no step emits the pairs
    of a group; the number of rounds grows with the logarithm of the nodes.
    """
    edges = saved(
        links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "links",
    )
    while True:
        before = _print(edges)
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = saved(large, "links")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi")
        small = moved.select("hi", F.col("m").alias("lo")).union(
            moved.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        )
        edges = saved(small.distinct(), "links")
        if _print(edges) == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("part"))


def _print(edges: DataFrame) -> tuple:
    """Count and two sums of hashes: equal for equal sets of links."""
    return tuple(
        edges.agg(
            F.count("*"),
            F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")),
            F.bit_xor(F.xxhash64("lo", "hi")),
        ).first()
    )
