"""Hard negatives by exact integer inner products, scored by the method of the four Russians.

Vectors become small integers.  A candidate is kept as bit planes: for every
binary digit (two's complement) one bit a dimension, packed into a byte for each
eight dimensions.  An anchor becomes a table for each eight dimensions with the
sums of all 256 subsets of its eight integers.  The inner product is then a sum
of table entries, one look-up a byte, shifted by one digit from plane to plane.
Scores are exact; nothing is sampled or approximated.

Work is dealt in cells, a block of anchors against a block of rows, so a task
holds bounded blocks however many rows there are.  The query set (anchors) meets
all rows twice: first rows of its own label, for the positives, then rows of
other labels, within bands that the positives' scores set.

Odd rows: a null label or vector, or a null or non-finite component, takes a row
out.  Shorter vectors count as padded with zeros; an empty vector scores zero.
A null id is never an anchor and comes last among ties.  Repeated rows are rows
of their own: a twin is one of its anchor's other rows, and a repeated anchor
repeats its result.  An empty table gives no rows; further columns are ignored.
Scores that could exceed 2^56 raise :class:`OverflowError`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import saved

SCALE = 256
ANCHOR_EVERY = 50
POSITIVES = 5
NEGATIVES = 3
# A negative scores between these hundredths of its positive.
BAND = (50, 95)
# The largest blocks of a cell; smaller tables are cut so that every core gets some.
ANCHORS_A_CELL = 4096
ROWS_A_CELL = 16_384
# Anchors whose tables are held at once, and rows scored against them at once: both stay in a core's cache.
TABLE_ANCHORS = 64
SCORED_ROWS = 512
_CELLS = 4_000_000


# --- integers and bit planes ---------------------------------------------------------


def pack(vectors: pa.Array, planes: int, groups: int) -> pa.Array:
    """Bit planes of each vector: ``planes`` digits from the lowest up, ``groups`` bytes each."""
    starts = np.asarray(vectors.offsets, dtype="int64")
    values = np.floor(np.asarray(vectors.values, dtype="float64") * SCALE).astype("int64")
    step = max(1, _CELLS // (planes * groups * 8))
    out = []
    for lo in range(0, len(vectors), step):
        hi = min(len(vectors), lo + step)
        sizes = np.diff(starts[lo : hi + 1])
        whole = np.zeros((hi - lo, groups * 8), dtype="int64")
        columns = np.arange(starts[lo], starts[hi]) - np.repeat(starts[lo:hi], sizes)
        whole[np.repeat(np.arange(hi - lo), sizes), columns] = values[starts[lo] : starts[hi]]
        bits = (whole[:, None, :] >> np.arange(planes)[None, :, None] & 1).astype("uint8")
        out.append(np.packbits(bits, axis=2, bitorder="little").reshape(hi - lo, planes * groups))
    width = planes * groups
    data = np.concatenate(out).tobytes() if out else b""
    offsets = np.arange(len(vectors) + 1, dtype="int32") * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def unpacked(planes: np.ndarray) -> np.ndarray:
    """Integers [rows, 8 * groups] of bit planes [rows, planes, groups]."""
    digits = planes.shape[1]
    bits = np.unpackbits(planes, axis=2, bitorder="little").astype("int64")
    weights = 1 << np.arange(digits, dtype="int64")
    weights[-1] = -weights[-1]
    return np.einsum("rpd,p->rd", bits, weights)


def subset_sums(anchors: np.ndarray, kind: str) -> np.ndarray:
    """[groups, 256, anchors]: for each eight dimensions the sum of every subset."""
    n, dims = anchors.shape
    by_group = anchors.reshape(n, dims // 8, 8).transpose(1, 2, 0)
    sums = np.zeros((dims // 8, 256, n), dtype=kind)
    for j in range(8):
        sums[:, 1 << j : 2 << j] = sums[:, : 1 << j] + by_group[:, j : j + 1]
    return sums


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """[anchors, rows]: exact inner products from table look-ups."""
    rows, digits, groups = planes.shape
    n = sums.shape[2]
    out = np.empty((n, rows), dtype=sums.dtype)
    for lo in range(0, rows, SCORED_ROWS):
        block = planes[lo : lo + SCORED_ROWS]
        total = np.zeros((len(block), n), dtype=sums.dtype)
        looked = np.empty_like(total)
        for p in range(digits - 1, -1, -1):
            np.left_shift(total, 1, out=total)
            for g in range(groups):
                np.take(sums[g], block[:, p, g], axis=0, out=looked)
                total += looked
            if p == digits - 1:
                np.negative(total, out=total)
        out[:, lo : lo + len(block)] = total.T
    return out


def best(found: np.ndarray, least: int, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ``count`` best columns of each row, the leftmost of ties first; used ones become ``least``."""
    every = np.arange(len(found))
    for _ in range(min(count, found.shape[1])):
        at = found.argmax(axis=1)
        value = found[every, at].copy()
        found[every, at] = least
        yield at, value


# --- cells ----------------------------------------------------------------------------


class _Block:
    """Rows of one cell as arrays, in the order of their ids."""

    def __init__(self, rows: pa.Table, digits: int, repeat: int):
        ids = rows["vec_id"].combine_chunks()
        self.missing = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0))
        self.labels = np.asarray(rows["label"].combine_chunks())
        packed = rows["packed"].combine_chunks()
        self.planes = np.frombuffer(b"".join(packed.to_pylist()), dtype="uint8").reshape(len(rows), digits, -1)
        if repeat:
            copies = np.minimum(np.asarray(rows["copies"].combine_chunks()), repeat)
            order = np.lexsort((self.ids, self.missing))
            picked = np.repeat(order, copies[order])
            self.missing, self.ids, self.labels, self.planes = (x[picked] for x in (self.missing, self.ids, self.labels, self.planes))


def _positives(digits: int, kind: str, count: int):
    """Best rows of the anchors' own labels in one cell; one more than asked for, as an anchor may find itself."""
    least = np.iinfo(kind).min

    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        parts = []
        if len(anchors) and len(rows):
            a, c = _Block(anchors, digits, 0), _Block(rows, digits, count + 1)
            numbers = np.asarray(anchors["a"].combine_chunks())
            for label in np.unique(a.labels):
                mine, theirs = np.flatnonzero(a.labels == label), np.flatnonzero(c.labels == label)
                if not len(theirs):
                    continue
                for lo in range(0, len(mine), TABLE_ANCHORS):
                    some = mine[lo : lo + TABLE_ANCHORS]
                    found = scores(subset_sums(unpacked(a.planes[some]), kind), c.planes[theirs])
                    for at, value in best(found, least, count + 1):
                        at = theirs[at]
                        own = ~c.missing[at] & (c.ids[at] == a.ids[some]) & (c.planes[at] == a.planes[some]).all(axis=(1, 2))
                        parts.append((numbers[some], a.ids[some], c.ids[at], c.missing[at], value.astype("int64"), own))
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, "int64")] * 6
        return pa.table(
            {
                "a": pa.array(columns[0], pa.int64()),
                "anchor_id": pa.array(columns[1], pa.int64()),
                "positive_id": pa.array(columns[2], pa.int64(), mask=columns[3].astype(bool)),
                "positive_score": pa.array(columns[4], pa.int64()),
                "own": pa.array(columns[5].astype(bool)),
            }
        )

    return cell


def _negatives(digits: int, kind: str, count: int, band: tuple[int, int]):
    """Best rows of other labels in one cell, for every anchor and band of a positive."""
    least = np.iinfo(kind).min

    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        parts = []
        if len(anchors) and len(rows):
            a, c = _Block(anchors, digits, 0), _Block(rows, digits, count)
            numbers = np.asarray(anchors["a"].combine_chunks())
            asked = anchors["positives"].combine_chunks()
            most = max(len(x) for x in asked)
            known = np.zeros((len(anchors), most), dtype=bool)
            upper, lower = np.zeros((2, len(anchors), most), dtype="int64")
            for i, values in enumerate(asked.to_pylist()):
                for k, value in enumerate(values):
                    known[i, k], upper[i, k], lower[i, k] = True, band[1] * value // 100, -(-band[0] * value // 100)
            for lo in range(0, len(anchors), TABLE_ANCHORS):
                some = np.arange(lo, min(lo + TABLE_ANCHORS, len(anchors)))
                found = scores(subset_sums(unpacked(a.planes[some]), kind), c.planes)
                found[a.labels[some][:, None] == c.labels[None, :]] = least
                for k in range(most):
                    # A band below the smallest score of this width holds no row.
                    high = np.clip(upper[some, k], least, np.iinfo(kind).max).astype(kind)
                    within = np.where(found <= high[:, None], found, least)
                    for at, value in best(within, least, count):
                        value = value.astype("int64")
                        good = known[some, k] & (value >= lower[some, k]) & (value > least)
                        if not good.any():
                            break
                        at, which = at[good], some[good]
                        parts.append((numbers[which], np.full(len(which), k + 1), c.ids[at], c.missing[at], value[good]))
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, "int64")] * 5
        return pa.table(
            {
                "a": pa.array(columns[0], pa.int64()),
                "k": pa.array(columns[1], pa.int32()),
                "negative_id": pa.array(columns[2], pa.int64(), mask=columns[3].astype(bool)),
                "negative_score": pa.array(columns[4], pa.int64()),
            }
        )

    return cell


def _dealt(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, work, schema: str) -> DataFrame:
    """Every block of anchors with every block of rows, one cell each."""
    spark = rows.sparkSession
    cores = max(1, spark.sparkContext.defaultParallelism)
    across = max(1, -(-n_anchors // ANCHORS_A_CELL))
    down = max(1, -(-n_rows // max(256, min(ROWS_A_CELL, -(-n_rows * across // (4 * cores))))))
    # More partitions than cells, so that few cells share one.
    partitions = min(2 * across * down, 100_000)

    def block(parts: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "packed"), F.lit(parts)).cast("int")

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    left = anchors.withColumn("_x", block(across)).withColumn("_y", every(down))
    right = rows.withColumn("_y", block(down)).withColumn("_x", every(across))
    cell = F.col("_x").cast("long") * down + F.col("_y")
    left = left.withColumn("_cell", cell).drop("_x", "_y").repartition(partitions, "_cell")
    right = right.withColumn("_cell", cell).drop("_x", "_y").repartition(partitions, "_cell")
    return left.groupBy("_cell").cogroup(right.groupBy("_cell")).applyInArrow(work, schema)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    band: tuple[int, int] = BAND,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has ``vec_id``, ``label`` and ``embedding``; ``anchor`` says
    which rows are anchors (by default one id in 50).  An anchor's positives are
    its best other rows of the same label.  For each, the best rows of other
    labels whose score lies within ``band`` hundredths of the positive's are
    returned, ranked; ties go to the smaller id.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), x).filter(F.col("label").isNotNull() & x.isNotNull() & finite)
    widest = kept.agg(F.max(F.size(x)), F.max(F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")))))).first()
    dims, largest = widest[0] or 1, SCALE * (widest[1] or 0.0)
    if dims * (largest + 1) ** 2 >= 2.0**56:
        raise OverflowError("inner products of these vectors may not fit")
    groups = -(-dims // 8)
    digits = int(largest + 1).bit_length() + 1
    kind = "int32" if dims * (largest + 1) ** 2 < 2.0**31 else "int64"
    packing = F.arrow_udf(lambda v: pack(v, digits, groups), "binary")
    rows = kept.select("vec_id", "label", packing(x).alias("packed"))
    rows = saved(rows.groupBy("vec_id", "label", "packed").agg(F.count("*").alias("copies")), "planes")
    which = F.pmod("vec_id", F.lit(ANCHOR_EVERY)) == 0 if anchor is None else anchor
    anchors = saved(rows.filter(which & F.col("vec_id").isNotNull()).withColumn("a", F.monotonically_increasing_id()), "anchors")
    n_rows, n_anchors = rows.count(), anchors.count()

    near = _dealt(
        anchors.select("a", "vec_id", "label", "packed"), rows, n_anchors, n_rows, _positives(digits, kind, positives),
        "a long, anchor_id long, positive_id long, positive_score long, own boolean",
    )
    # Among equal ids and scores the anchor itself comes first; one such row is itself and goes.
    order = [F.desc("positive_score"), F.asc_nulls_last("positive_id"), F.desc("own")]
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(*order))).filter(F.col("place") <= positives + 1)
    itself = F.min(F.when(F.col("own"), F.col("place"))).over(Window.partitionBy("a"))
    near = near.withColumn("itself", F.coalesce(itself, F.lit(positives + 1))).filter("place <> itself")
    near = near.select("a", "anchor_id", "positive_id", "positive_score", (F.col("place") - (F.col("place") > F.col("itself")).cast("int")).alias("k"))
    near = saved(near, "positives")

    bands = near.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "positive_score"))), lambda s: s["positive_score"]).alias("positives"))
    asking = anchors.select("a", "vec_id", "label", "packed").join(bands, "a")
    far = _dealt(
        asking, rows, n_anchors, n_rows, _negatives(digits, kind, negatives, band),
        "a long, k int, negative_id long, negative_score long",
    )
    order = [F.desc("negative_score"), F.asc_nulls_last("negative_id")]
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("a", "k").orderBy(*order))).filter(F.col("rank") <= negatives)
    out = far.join(near, ["a", "k"]).join(anchors.select("a", "copies"), "a")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
