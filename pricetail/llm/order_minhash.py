"""Order MinHash fingerprints, which feel edit distance.

A text is taken as its k-mers of eight UTF-8 bytes, each numbered by its
occurrence, so that repeats count.  For each of the fingerprint's components a
permutation of the numbered k-mers names the two smallest; they are put in the
order of the text, and the hash of the pair is the component.  Moving blocks
around changes components although the set of k-mers stays the same.  The
likeness of two fingerprints is the share of equal components.

Neighbours in the order of ids are brought together by one shuffle: ids from a
bounded sample cut the order into ranges, a document goes to the partition of its
range, and the first document of a range also goes to the one before.

Defined results: null is the empty text; its fingerprint is zero and like itself
only; texts under eight bytes are one padded k-mer; very long texts are worked
through permutation by permutation.  Null ids come first, repeated ids are
ordered by text; a single document is its own neighbour; an empty table gives an
empty table; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = 48
SEED = 20
K = 8
# Numbers that a permutation step handles at once.
_CELLS = 1 << 20
# Documents in a range, most ranges, and ids sampled for each range.
RANGE_ROWS = 4_000
MOST_RANGES = 10_000
SAMPLE = 20

_RANDOM = np.random.default_rng(SEED)
_FLIP = _RANDOM.integers(0, 1 << 32, (COMPONENTS, 1), dtype=np.uint32)
_TIMES = _RANDOM.integers(0, 1 << 32, (COMPONENTS, 1), dtype=np.uint32) | np.uint32(1)
_ODD = (_RANDOM.integers(0, 1 << 63, 4, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _ODD[0]
    h ^= h >> np.uint64(32)
    h *= _ODD[1]
    h ^= h >> np.uint64(29)
    return h


def numbered_kmers(text: bytes) -> np.ndarray:
    """A 32-bit hash of every k-mer with its occurrence number, in text order."""
    n = len(text) - K + 1
    if n <= 0:
        text, n = text.ljust(K, b"\0"), 1
    h = _mixed(np.ndarray((n,), "<u8", text, strides=(1,)).copy())
    if n > 1:
        # Sorted by hash, then place: k-mers that occur again stand side by side.
        bits = np.uint64(n.bit_length())
        low = (np.uint64(1) << bits) - np.uint64(1)
        key = (h & ~low) | np.arange(n, dtype=np.uint64)
        key.sort()
        same = (key[1:] ^ key[:-1]) <= low
        if same.any():
            starts = np.flatnonzero(np.concatenate(([True], ~same)))
            number = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            again = number > 0
            place = (key[again] & low).astype(np.int64)
            h[place] += number[again].astype(np.uint64) * _ODD[2]
    return (_mixed(h) >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str | None) -> np.ndarray:
    """COMPONENTS 32-bit numbers."""
    if not text:
        return np.zeros(COMPONENTS, np.uint32)
    kmers = numbered_kmers(text.encode())
    out = np.empty(COMPONENTS, np.uint32)
    step = max(1, _CELLS // len(kmers))
    for k in range(0, COMPONENTS, step):
        order = (kmers ^ _FLIP[k : k + step]) * _TIMES[k : k + step]
        rows = np.arange(len(order))
        one = order.argmin(axis=1)
        order[rows, one] = 0xFFFFFFFF
        two = order.argmin(axis=1) if len(kmers) > 1 else one
        first, second = kmers[np.minimum(one, two)], kmers[np.maximum(one, two)]
        pair = (first.astype(np.uint64) << np.uint64(32)) | second
        out[k : k + step] = (_mixed(pair) >> np.uint64(32)).astype(np.uint32)
    # Zero is the empty text's.
    out[out == 0] = 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def shown(fp: np.ndarray) -> str:
    return fp.astype(">u4").tobytes().hex()


def order_minhash(text: Column) -> Column:
    """The fingerprint as hexadecimal digits."""

    @F.arrow_udf("string")
    def hashed(rows: pa.Array) -> pa.Array:
        return pa.array([shown(fingerprint(t)) for t in rows.to_pylist()], pa.string())

    return hashed(text)


def edited(text: str, following: str) -> str:
    """The text with its second half replaced by as much of the following one's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _cuts(ids: DataFrame) -> list:
    """Ids that cut the order into ranges: all but the smallest of a bounded sample, evenly taken."""
    rows, least = ids.agg(F.count("*"), F.min("id")).first()
    ranges = min(MOST_RANGES, -(-rows // RANGE_ROWS))
    if ranges < 2:
        return []
    every = max(1, rows // (ranges * SAMPLE))
    sample = sorted({r.id for r in ids.filter("id IS NOT NULL").filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("id").distinct().limit(4 * ranges * SAMPLE).collect()})
    return sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)} - {least}) if sample else []


def with_following(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, int]:
    """(id, text, own, last) in partitions by range of ids, each followed by the row after its last own one."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = rows.select("id")
    cuts = _cuts(ids)
    n = len(cuts) + 1
    least = ids.agg(F.count(F.when(F.col("id").isNull(), 1)), F.min("id")).first()
    known = set(cuts)

    @F.arrow_udf("array<int>")
    def places(column: pa.Array) -> pa.Array:
        out = []
        for i in column.to_pylist():
            own = 0 if i is None else bisect_right(cuts, i)
            first = i is None if least[0] else i == least[1]
            # own range, the one before if it starts here, and behind the last one
            out.append([own] + [own - 1] * (i in known) + [n] * first)
        return pa.array(out, pa.list_(pa.int32()))

    spread = rows.withColumn("places", places("id")).select(
        "id", "text", F.posexplode("places").alias("copy", "place")
    )
    spread = spread.select(
        "id", "text", (F.col("copy") == 0).alias("own"), (F.col("place") == n).alias("last"),
        F.least("place", F.lit(n - 1)).alias("place"),
    )
    return spread.repartitionById(n, F.col("place")).sortWithinPartitions("last", F.asc_nulls_first("id"), F.desc("own"), "text"), n


def edit_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they and the next text's are."""
    rows, _ = with_following(docs, id_col, text)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out, types = None, [[] for _ in names], None
        for batch in batches:
            types = [batch.schema.field("id").type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            for i, body, own in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "own"))):
                if not own and (before is None or not before[2]):
                    continue
                fp = fingerprint(body)
                if before is not None and before[2]:
                    changed = edited(before[1], body)
                    fp2 = fingerprint(changed)
                    row = (
                        before[0], len(before[1]), hashlib.sha256(changed.encode()).hexdigest(),
                        shown(before[3]), shown(fp2), likeness(before[3], fp2), likeness(before[3], fp),
                    )
                    for column, value in zip(out, row):
                        column.append(value)
                before = i, body, own, fp
                if len(out[0]) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
                    out = [[] for _ in names]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return rows.select("id", "text", "own").mapInArrow(report, schema)
