"""SimHash near-duplicates found through Golay-code keys.

Fingerprint: words of the text with A-Z in lower case, shingles of three words
(fewer words: the whole sequence), XXH64 of each; a bit of the fingerprint is 1
if it is set in more than half of the hashes.

Two fingerprints link if they differ in at most three of 64 bits.  The 64 bits are
four segments of 16.  Three errors leave at least one segment i without error
whose neighbour i+1 has two errors at most: (3), (2,1) and (1,1,1) errors over
four segments all do.  So a fingerprint gets, for each i, the keys

    (i, segment i as it is, index of a codeword near segment i+1)

where a codeword of the perfect binary (23,12) Golay code is near if it differs
from the zero-padded segment in four bits at most.  The code corrects three
errors, so every vector has one codeword within three bits; a vector at three
bits from it has five more at four bits.  Two vectors that differ in at most two
bits always share one of these one or six codewords.

Fingerprints that share a key are compared exactly.  A key shared by many
different fingerprints is dealt in blocks: every pair of blocks is one bounded
group, compared with numpy; only links that join parts that were apart are given
on, at most one less than the fingerprints of the group.  Copies have one
fingerprint and are compared once.

Defined results: null and empty texts have fingerprint zero and link like any
other; texts of any length are read whole; repeated rows are kept; an empty table
gives an empty table; extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh, saved
from .components import components

SEED = 42
SHINGLE = 3
# Most differing bits of two linked fingerprints.
REACH = 3
# Fingerprints of one key that a task compares with each other at once.
BLOCK = 1024
# The generator polynomial of the (23,12) Golay code.
GENERATOR = 0xAE3
_CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *stops[: -SHINGLE].tolist()]
    stops = (stops[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, len(starts), _CHUNK):
        part = [digest(line[a:b], SEED) for a, b in zip(starts[k : k + _CHUNK], stops[k : k + _CHUNK])]
        # Row by shingle, column by bit: the first column is the highest bit.
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    high = counts * 2 > len(starts)
    return int.from_bytes(np.packbits(high).tobytes(), "big")


def fingerprints(text: Column) -> Column:
    """The fingerprint as a signed 64-bit integer with the same bits."""

    @F.arrow_udf("long")
    def simhash(rows: pa.Array) -> pa.Array:
        found = np.array([fingerprint(t) for t in rows.to_pylist()], np.uint64)
        return pa.array(found.view(np.int64))

    return simhash(text.cast("binary"))


def hexadecimal(value: Column) -> Column:
    """16 lower-case hexadecimal digits of the bits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


_NEAR: list[list[int]] = []


def near_codewords() -> list[list[int]]:
    """For each 16-bit segment, the 12-bit indices of the codewords within four bits of it."""
    if not _NEAR:
        index = np.arange(1 << 12, dtype=np.uint32)
        words = np.zeros(1 << 12, np.uint32)
        for bit in range(12):
            # Message bit times generator: the code is the span of the shifted polynomial.
            words ^= np.where(index >> bit & 1, np.uint32(GENERATOR << bit), np.uint32(0))
        # A codeword with more than four bits in the zero padding is near no segment.
        some = np.flatnonzero(np.bitwise_count(words >> 16) <= 4)
        for first in range(0, 1 << 16, 1 << 10):
            segments = np.arange(first, first + (1 << 10), dtype=np.uint32)
            close = np.bitwise_count(segments[:, None] ^ words[some][None, :]) <= 4
            _NEAR.extend(some[row].tolist() for row in close)
    return _NEAR


def golay_keys(prints: DataFrame) -> DataFrame:
    """(fp, key) with the keys of each distinct fingerprint."""

    @F.arrow_udf("array<long>")
    def keys(rows: pa.Array) -> pa.Array:
        near = near_codewords()
        out = []
        for fp in rows.to_numpy(zero_copy_only=False).view(np.uint64).tolist():
            segments = [fp >> shift & 0xFFFF for shift in (48, 32, 16, 0)]
            out.append([i << 28 | segments[i] << 12 | c for i in range(4) for c in near[segments[(i + 1) % 4]]])
        return pa.array(out, pa.list_(pa.int64()))

    return prints.select("fp", F.explode(keys("fp")).alias("key"))


def _joining(fps: np.ndarray, split: int) -> list[tuple[int, int]]:
    """Links that put together all that REACH connects within a group.

    A breadth-first search that takes every fingerprint out once it is reached;
    with split > 0 only the first split fingerprints are compared with the others.
    """
    bits = fps.view(np.uint64)  # the count of a negative number's bits is that of its absolute value
    rest = np.arange(len(fps))
    side = (rest < split) if split else None
    out = []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            k = todo.pop()
            hit = np.bitwise_count(bits[rest] ^ bits[k]) <= REACH
            if side is not None:
                hit &= side[rest] != side[k]
            if hit.any():
                reached = rest[hit]
                out += [(int(fps[k]), int(fps[j])) for j in reached]
                todo += reached.tolist()
                rest = rest[~hit]
    return out


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): enough linked pairs of distinct fingerprints (column fp) to connect all that link."""
    keyed = golay_keys(prints)
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = keyed.join(counts, "key").select(
        "key", "fp", F.ceil(F.col("n") / block).cast("int").alias("blocks")
    ).withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    # Each block meets itself and every other block of its key.
    met = dealt.select(
        "key", "fp", "mine",
        F.explode(F.expr("transform(sequence(0, blocks - 1), j -> struct(least(mine, j) AS lo, greatest(mine, j) AS hi))")).alias("pair"),
    )
    groups = met.groupBy("key", "pair").agg(
        F.collect_set(F.when(F.col("mine") == F.col("pair.lo"), F.col("fp"))).alias("low"),
        F.collect_set(F.when(F.col("mine") != F.col("pair.lo"), F.col("fp"))).alias("high"),
    )

    @F.arrow_udf("array<struct<a:long,b:long>>")
    def joined(low: pa.Array, high: pa.Array) -> pa.Array:
        out = []
        for left, right in zip(low.to_pylist(), high.to_pylist()):
            fps = np.array(left + right, np.int64)
            out.append([{"a": a, "b": b} for a, b in _joining(fps, len(left) if right else 0)])
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return groups.select(F.explode(joined("low", "high")).alias("e")).select("e.a", "e.b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs.

    ``component_id`` is the smallest id that links lead to, the row's own included.
    """
    prints = saved(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text)).alias("fp")), "prints")
    # One row for a fingerprint: copies are compared once.
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    parts = components(links(least.select("fp"), block))
    first = least.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("part", "fp").alias("part")
    )
    smallest = first.groupBy("part").agg(F.min("least").alias("component_id"))
    where = first.join(smallest, "part").select("fp", "component_id")
    return prints.join(where, "fp").select(
        F.col("id").alias(id_col), hexadecimal(F.col("fp")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that have a near-duplicate with a smaller id.

    Of rows that repeat an id with different texts of one group, each is kept; rows with a null
    id are in no group and stay.
    """
    taken = fresh(docs.columns, "near_id", "near_group")
    found = near_duplicates(docs.filter(F.col(id_col).isNotNull()), id_col, text)
    later = found.filter(F.col(id_col) != F.col("component_id")).select(
        F.col(id_col).alias(taken[0])
    ).distinct()
    return docs.join(later, F.col(id_col) == F.col(taken[0]), "left_anti")
