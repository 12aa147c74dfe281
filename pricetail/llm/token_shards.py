"""Training order: fixed-size token sequences in a keyed permutation, for sequential reads.

Texts become token ids with an end id after each; a document's ids are cut into
sequences of ``LENGTH`` and the last is filled up.  Tasks number the sequences they
make and the numbers are shifted by the totals of the tasks before, so every
sequence has an index from 0 to N - 1.  A Feistel network, keyed by a seed, permutes
the smallest even power of two that holds N; an image beyond N is mapped again until
it is below (cycle walking), which gives a permutation of 0 to N - 1 that needs no
table.  The image is the sequence's slot.  Slots are dealt by ranges of
``SHARD_RECORDS``; a shard holds records of one size, so a slot's place is its shard
times a fixed stride, and a reader that stopped goes on at any slot.

A record is the number of its tokens, then LENGTH token ids, all little-endian
unsigned 16-bit integers.

Defined results: null and empty texts give one sequence that holds the end id
alone; texts of any length are cut whole; repeated rows give sequences of their
own; an empty table gives no sequence; other columns don't matter.  Numbers follow
the order of the input's partitions: the same table and layout give the same slots.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import saved

LENGTH = 512
SHARD_RECORDS = 1 << 16
ROUNDS = 6
SEED = 2024
STRIDE = 2 * (LENGTH + 1)
BATCH = 2000  # records sent to Spark at once

_ENCODINGS: dict[bytes, tiktoken.Encoding] = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    if ranks not in _ENCODINGS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODINGS[ranks] = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[ranks]


def _packed(ids: list[int]) -> np.ndarray:
    """Ids as two bytes each, without a look at every Python number by numpy."""
    return np.frombuffer(array("H", ids), np.uint16).astype("<u2", copy=False)


def permuted(index: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The slot of every index below n: a bijection of 0..n-1."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng(seed).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for key in keys:
            f = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def tokenised(docs: DataFrame, ranks: bytes, pattern: str, id_col: str, text: str) -> DataFrame:
    """(id, tokens, n_tokens, n_sequences, part, first): ids as bytes, and the number of the row's first sequence in its task."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([ranks.count(b"\n")], "<u2").tobytes()  # the id after the last rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, first = encoding(ranks, pattern).encode_ordinary, TaskContext.get().partitionId(), 0
        for batch in batches:
            tokens, firsts = [], []
            for t in batch.column("text").to_pylist():
                ids = _packed(encode(t)).tobytes() + end if t else end
                tokens.append(ids)
                firsts.append(first)
                first += -(-len(ids) // (2 * LENGTH))
            sizes = [len(t) // 2 for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(tokens, pa.binary()), pa.array(sizes, pa.int64()),
                    pa.array([-(-n // LENGTH) for n in sizes], pa.int32()), pa.array([part] * len(tokens), pa.int32()), pa.array(firsts, pa.int64()),
                ],
                ["id", "tokens", "n_tokens", "n_sequences", "part", "first"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, tokens binary, n_tokens long, n_sequences int, part int, first long")


def counted(docs: DataFrame, ranks: bytes, pattern: str, text: str) -> DataFrame:
    """(part, n_sequences): the sequences that each batch of a task makes, without their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoding(ranks, pattern).encode_ordinary, TaskContext.get().partitionId()
        for batch in batches:
            made = sum(-(-(len(encode(t)) + 1) // LENGTH) if t else 1 for t in batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([made], pa.int64())], ["part", "n_sequences"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "part int, n_sequences long")


def sequences_again(
    docs: DataFrame, ranks: bytes, pattern: str, id_col: str, text: str, made: dict[int, int], seed: int
) -> DataFrame:
    """(id, chunk, slot, n_tokens, record) in one pass.  made: what each task made when it was counted."""
    kind = docs.schema[id_col].dataType.simpleString()
    end, n = ranks.count(b"\n"), sum(made.values())
    offsets, total = {}, 0
    for part in sorted(made):
        offsets[part] = total
        total += made[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoding(ranks, pattern).encode_ordinary, TaskContext.get().partitionId()
        first, stop = offsets.get(part, 0), offsets.get(part, 0) + made.get(part, 0)

        def records(t: str | None) -> np.ndarray:
            # The end is there already: records are filled with it.
            ids = _packed(encode(t) if t else [])
            m = len(ids) // LENGTH + 1
            full = (m - 1) * LENGTH
            out = np.full((m, LENGTH + 1), end, "<u2")
            out[:, 0] = LENGTH
            out[-1, 0] = len(ids) + 1 - full
            out[:-1, 1:] = ids[:full].reshape(m - 1, LENGTH)
            out[-1, 1 : 1 + len(ids) - full] = ids[full:]
            return out

        def sent(ids: pa.Array, rows: list[int], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal first
            row = np.repeat(rows, [len(x) for x in found])
            chunk = np.concatenate([np.arange(len(x), dtype=np.int32) for x in found])
            whole = np.concatenate(found)
            for k in range(0, len(whole), BATCH):
                some = whole[k : k + BATCH]
                if first + len(some) > stop:
                    raise RuntimeError("the input has changed since its sequences were counted")
                slot = permuted(np.arange(first, first + len(some)), n, seed)
                first += len(some)
                ends = np.arange(len(some) + 1, dtype=np.int32) * STRIDE
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(row[k : k + BATCH])), pa.array(chunk[k : k + BATCH]), pa.array(slot), pa.array(some[:, 0].astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(some.tobytes())]),
                    ],
                    ["id", "chunk", "slot", "n_tokens", "record"],
                )

        for batch in batches:
            rows, found, waiting = [], [], 0
            for row, t in enumerate(batch.column("text")):
                rows.append(row)
                found.append(records(t.as_py()))
                waiting += len(found[-1])
                if waiting >= BATCH:
                    yield from sent(batch.column("id"), rows, found)
                    rows, found, waiting = [], [], 0
            if rows:
                yield from sent(batch.column("id"), rows, found)
        if first != stop:
            raise RuntimeError("the input has changed since its sequences were counted")

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, chunk int, slot long, n_tokens int, record binary")


def _two_bytes(n: Column) -> Column:
    low, high = F.lpad(F.hex(F.pmod(n, F.lit(256))), 2, "0"), F.lpad(F.hex(F.floor(n / 256)), 2, "0")
    return F.unhex(F.concat(low, high))


def training_order(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(id, chunk, slot, shard, place, n_tokens, record), dealt by shard and sorted by slot."""
    rows = saved(tokenised(docs, ranks, pattern, id_col, text), "tokens")
    return _ordered(rows, ranks, id_col, seed)[0]


def _ordered(rows: DataFrame, ranks: bytes, id_col: str, seed: int) -> tuple[DataFrame, int]:
    """The training order of saved tokens and the number of its sequences."""
    # One row for each task that made tokens.
    parts = rows.groupBy("part").agg(F.sum(F.col("n_sequences").cast("long")).alias("made"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("made").over(before), F.lit(0)).alias("offset"))
    n = parts.agg(F.sum("made")).first()[0] or 0

    @F.arrow_udf("long")
    def slot(index: pa.Array) -> pa.Array:
        return pa.array(permuted(index.to_numpy(zero_copy_only=False), n, seed))

    sequences = rows.join(F.broadcast(offsets), "part").select(
        "id", "tokens", F.col("n_tokens").alias("all_tokens"), (F.col("offset") + F.col("first")).alias("base"),
        F.explode(F.sequence(F.lit(0), F.col("n_sequences") - 1)).alias("chunk"),
    )
    length = F.least(F.col("all_tokens") - F.col("chunk") * LENGTH, F.lit(LENGTH)).cast("int")
    fill = bytearray(_end_bytes(ranks))
    # Bytes first, padding after: both stay binary.
    piece = F.substring("tokens", F.col("chunk") * (2 * LENGTH) + 1, F.lit(2 * LENGTH))
    dealt = sequences.withColumn("slot", slot(F.col("base") + F.col("chunk"))).select(
        "id", "chunk", "slot", length.alias("n_tokens"), F.concat(_two_bytes(length), F.rpad(piece, 2 * LENGTH, F.lit(fill))).alias("record")
    )
    return _by_shard(dealt, n, id_col), n


def _by_shard(sequences: DataFrame, n: int, id_col: str) -> DataFrame:
    return (
        sequences.select(
            F.col("id").alias(id_col), "chunk", "slot",
            F.floor(F.col("slot") / SHARD_RECORDS).cast("int").alias("shard"),
            F.pmod("slot", F.lit(SHARD_RECORDS)).cast("int").alias("place"),
            "n_tokens", "record",
        )
        .repartitionById(max(1, -(-n // SHARD_RECORDS)), F.col("shard"))
        .sortWithinPartitions("slot")
    )


def sharded(
    docs: DataFrame, ranks: bytes, pattern: str, path: str, id_col: str = "doc_id", text: str = "text", seed: int = SEED, again: bool = False
) -> DataFrame:
    """Write the shards of docs to path, once, and return (shard, file, records, bytes, sha256).

    Tokens are written and read back, whatever the input.  With ``again`` only their
    counts are and texts are encoded a second time, which takes less disk and more CPU;
    the input must then come in the same partitions and order, as a table of files does.
    Raises if the shards don't hold every sequence once.
    """
    if again:
        counts = saved(counted(docs, ranks, pattern, text), "counts")
        # One row for each task that made tokens.
        made = {r.part: r.made for r in counts.groupBy("part").agg(F.sum("n_sequences").alias("made")).collect()}
        n = sum(made.values())
        ordered = _by_shard(sequences_again(docs, ranks, pattern, id_col, text, made, seed), n, id_col)
    else:
        ordered, n = _ordered(saved(tokenised(docs, ranks, pattern, id_col, text), "tokens"), ranks, id_col, seed)
    shards = saved(write_shards(ordered, path), "shards")
    written = shards.agg(F.sum("records")).first()[0] or 0
    if written != n:
        raise RuntimeError(f"{written} of {n} sequences were written: the input has changed between two reads")
    return shards


def _end_bytes(ranks: bytes) -> bytes:
    return np.array([ranks.count(b"\n")], "<u2").tobytes()


def write_shards(ordered: DataFrame, path: str) -> DataFrame:
    """Write one file for each shard and return (shard, file, records, bytes, sha256).

    A task writes under a name of its own and renames when all is written, so that a
    task that runs again or twice leaves whole files only.  path: any URI that
    pyarrow opens and all executors share.  A shard whose places don't follow each
    other from 0 on is an error.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        open_shard, out, name, done = None, None, "", []
        digest, records = hashlib.sha256(), 0

        def close() -> None:
            out.close()
            target = f"{root}/shard-{open_shard:06d}.bin"
            fs.move(name, target)
            done.append((open_shard, target, records, records * STRIDE, digest.hexdigest()))

        for batch in batches:
            of, places = batch.column("shard").to_numpy(), batch.column("place").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                shard = int(of[a])
                if shard != open_shard:
                    if out:
                        close()
                    open_shard, digest, records = shard, hashlib.sha256(), 0
                    name = f"{root}/part-{shard:06d}-{task.taskAttemptId()}"
                    out = fs.open_output_stream(name)
                if (places[a:b] != np.arange(records, records + b - a)).any():
                    raise ValueError(f"shard {shard} lacks a slot or has one twice")
                some = b"".join(batch.column("record").slice(a, b - a).to_pylist())
                out.write(some)
                digest.update(some)
                records += b - a
        if out:
            close()
        columns = list(zip(*done)) or [[]] * 5
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["shard", "file", "records", "bytes", "sha256"]
        )

    return ordered.select("shard", "place", "record").mapInArrow(write, "shard int, file string, records long, bytes long, sha256 string")


def read_slots(path: str, start: int, count: int) -> Iterator[np.ndarray]:
    """Token ids of the sequences in slots start, start + 1, ..., read in order."""
    fs, root = pafs.FileSystem.from_uri(path)
    slot = start
    while slot < start + count:
        shard, place = divmod(slot, SHARD_RECORDS)
        with fs.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
            f.seek(place * STRIDE)
            for _ in range(min(start + count - slot, SHARD_RECORDS - place)):
                record = np.frombuffer(f.read(STRIDE), "<u2")
                if not len(record):
                    return
                yield record[1 : 1 + record[0]]
                slot += 1
