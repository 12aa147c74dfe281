"""Line dedup by pairwise alignment of overlapping documents.

A line with a word is known by the hash of its text without outer white space.
Single short lines are common and say little, so documents find each other by
rare runs: from every line on, as many lines as hold ``MIN_WORDS`` words.  A run
nominates one pair for each document that has it, with the first document that
has it, so that a passage found in any number of documents gives as many pairs.

Each pair is aligned by patience diff over its common lines: lines that both have
once, in the longest order that both share, are fixed first; what stands between
them is aligned in the same way; where no such line is left, equal lines from the
front and from the back are.  Blocks of lines that follow each other in both and
hold ``MIN_WORDS`` words go from the later document; the earlier one keeps them.
What is left of the later one is aligned again until no such block is found.  An
alignment can still pass over a block that stands in another order than short lines,
or that repeated lines hide; so at last every run of lines that is left in both and
holds ``MIN_WORDS`` words is looked up, whatever its order, and goes from the later.

"Later" is the greater id.  Defined results: null and empty texts, and rows with
a null id, stay as they are and nominate nobody; rows with equal ids don't dedup
each other, but each is aligned with earlier documents; texts of any length are
read whole; an empty table gives an empty table; other columns are kept, whatever
their names.  What stands of a text keeps its line ends; white-space lines within
a deleted block go with it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, saved

# Words in the smallest block that is deleted; half of a passage that must not repeat.
MIN_WORDS = 25

_LINE = pa.struct([("hash", pa.int64()), ("words", pa.int32()), ("place", pa.list_(pa.int32())), ("line", pa.list_(pa.int32()))])
_SHEET = pa.struct([("lines", pa.list_(_LINE)), ("runs", pa.list_(pa.int64()))])


def _signed(n: int) -> int:
    return n - (n >> 63 << 64)


def sheet(text: bytes | None, min_words: int) -> dict:
    """The distinct lines of a text with their places, and its runs.

    ``place`` counts lines with a word, ``line`` all lines.
    """
    hashes, words, at = [], [], []
    for k, line in enumerate((text or b"").split(b"\n")):
        n = len(line.split())
        if n:
            hashes.append(_signed(xxhash.xxh64_intdigest(line.strip())))
            words.append(n)
            at.append(k)
    found: dict[int, dict] = {}
    for p, (h, n, k) in enumerate(zip(hashes, words, at)):
        row = found.setdefault(h, {"hash": h, "words": n, "place": [], "line": []})
        row["place"].append(p)
        row["line"].append(k)
    runs, stop, inside = set(), 0, 0
    packed = np.array(hashes, np.int64)
    for start in range(len(hashes)):
        while stop < len(hashes) and inside < min_words:
            inside += words[stop]
            stop += 1
        if inside < min_words:
            break
        runs.add(_signed(xxhash.xxh64_intdigest(packed[start:stop].tobytes())))
        inside -= words[start]
    return {"lines": list(found.values()), "runs": sorted(runs)}


def _increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tails, ends, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back[i] = ends[k - 1] if k else -1
        tails[k : k + 1] = [v]
        ends[k : k + 1] = [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned indices of two sequences, increasing in both."""
    out: list[tuple[int, int]] = []
    regions = [(0, len(a), 0, len(b))]
    while regions:
        a0, a1, b0, b1 = regions.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[j]: j for j in range(b0, b1) if once_b[b[j]] == 1}
        both = [(i, where[a[i]]) for i in range(a0, a1) if once_a[a[i]] == 1 and a[i] in where]
        if both:
            fixed = [both[k] for k in _increasing([j for _, j in both])]
            out += fixed
            edges = [(a0 - 1, b0 - 1), *fixed, (a1, b1)]
            regions += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
            continue
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
    return sorted(out)


def _longest_matches(early: list[int], late: list[int | None]) -> list[int]:
    """For every place of late, how many items that end there follow each other in early too.

    A suffix automaton of early, read along late: time in proportion to both.  None matches nothing.
    """
    go, link, size, last = [{}], [-1], [0], 0
    for c in early:
        here, p = len(go), last
        go.append({})
        link.append(0)
        size.append(size[last] + 1)
        while p >= 0 and c not in go[p]:
            go[p][c] = here
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[q] > size[p] + 1:
                copy = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                link[q] = copy
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                q = copy
            link[here] = q
        last = here
    out, at, n = [], 0, 0
    for c in late:
        while at and c not in go[at]:
            at = link[at]
            n = size[at]
        if c in go[at]:
            at, n = go[at][c], n + 1
        out.append(n)
    return out


def shared_runs(early: list[tuple], late: list[tuple], words: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """(first line, last line, words) of what runs of min_words words cover, that stand in both in any order.

    early: sorted (place, key); late: sorted (place, key, line).  words: by key.
    """
    heaviest, inside, before = 0, 0, -2
    for q, k, _ in late:
        inside = words[k] + (inside if q == before + 1 else 0)
        heaviest, before = max(heaviest, inside), q
    if heaviest < min_words:
        return []
    # A gap in the places ends a run: a number of its own in early, None in late.
    one: list[int] = []
    for n, (p, k) in enumerate(early):
        if n and p != early[n - 1][0] + 1:
            one.append(-n)
        one.append(k)
    two, at = [], []
    for n, (q, k, _) in enumerate(late):
        if n and q != late[n - 1][0] + 1:
            two.append(None)
        at.append(len(two))
        two.append(k)
    matches = _longest_matches(one, two)
    sums = [0]
    for _, k, _ in late:
        sums.append(sums[-1] + words[k])
    out: list[tuple[int, int]] = []  # ranges of late
    for n in range(len(late)):
        first = n + 1 - matches[at[n]]
        if sums[n + 1] - sums[first] < min_words:
            continue
        while out and first < out[-1][1]:
            first = min(first, out.pop()[0])
        out.append((first, n + 1))
    return [(late[a][2], late[b - 1][2], sums[b] - sums[a]) for a, b in out if b > a]


def common_blocks(shared: list[dict], min_words: int) -> list[tuple[int, int, int]]:
    """(first line, last line, words) of the later text's aligned blocks.

    shared: for each common line its words, ``early`` and ``late`` places and the
    late text's line numbers.
    """
    early = sorted((p, k) for k, row in enumerate(shared) for p in row["early"])
    late = sorted((p, k, line) for k, row in enumerate(shared) for p, line in zip(row["late"], row["line"]))
    out: list[tuple[int, int, int]] = []
    while late:
        blocks, last = [], (-2, -2)
        for i, j in patience([k for _, k in early], [k for _, k, _ in late]):
            p, (q, k, line) = early[i][0], late[j]
            if (p - 1, q - 1) == last:
                blocks[-1] = (blocks[-1][0], line, blocks[-1][2] + shared[k]["words"])
            else:
                blocks.append((line, line, shared[k]["words"]))
            last = p, q
        found = [b for b in blocks if b[2] >= min_words]
        if not found:
            out += shared_runs(early, late, [row["words"] for row in shared], min_words)
            break
        out += found
        # Blocks in another order can't all be aligned at once: what is left is aligned again.
        late = [x for x in late if not any(a <= x[2] <= b for a, b, _ in found)]
    return sorted(out)


def deleted_blocks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, blocks): the line ranges that go from each document, for documents that lose any."""

    @F.arrow_udf("struct<lines: array<struct<hash: long, words: int, place: array<int>, line: array<int>>>, runs: array<long>>")
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([sheet(t, min_words) for t in texts.to_pylist()], _SHEET)

    @F.arrow_udf("array<struct<first: int, last: int, words: long>>")
    def align(shared: pa.Array) -> pa.Array:
        rows = [[{"first": a, "last": b, "words": n} for a, b, n in common_blocks(s, min_words)] for s in shared.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("words", pa.int64())])))

    sheets = saved(
        docs.filter(F.col(id_col).isNotNull()).select(
            F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("version"), read(F.col(text).cast("binary")).alias("sheet")
        ),
        "sheets",
    )
    runs = sheets.select("id", "version", F.explode("sheet.runs").alias("run"))
    first = runs.groupBy("run").agg(F.min(F.struct("id", "version")).alias("early"), F.max("id").alias("last")).filter("early.id < last")
    pairs = saved(
        runs.join(first.select("run", "early"), "run")
        .filter(F.col("id") > F.col("early.id"))
        .select("id", "version", F.col("early.id").alias("early_id"), F.col("early.version").alias("early_version"))
        .distinct(),
        "pairs",
    )
    # Only lines that both have meet: by document and line, so a much-copied document is spread by its lines.
    lines = sheets.select("id", "version", F.explode("sheet.lines").alias("x")).select("id", "version", "x.*").distinct()
    late = pairs.join(lines, ["id", "version"])
    early = lines.select(
        F.col("id").alias("early_id"), F.col("version").alias("early_version"), "hash", F.col("place").alias("early")
    )
    shared = late.join(early, ["early_id", "early_version", "hash"]).groupBy("id", "version", "early_id", "early_version").agg(
        F.array_sort(F.collect_list(F.struct("hash", "words", "early", F.col("place").alias("late"), "line"))).alias("shared")
    )
    return (
        shared.select("id", "version", F.explode(align("shared")).alias("block"))
        .groupBy("id", "version")
        .agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """The documents without the blocks that an earlier document has.

    With ``report`` the columns n_lines and n_deleted_lines are added.
    """
    i, version, blocks, lines, kept = fresh([*docs.columns, "n_lines", "n_deleted_lines"], "dedup_id", "dedup_version", "dedup_blocks", "dedup_lines", "dedup_kept")
    gone = deleted_blocks(docs, id_col, text, min_words).select(
        F.col("id").alias(i), F.col("version").alias(version), F.col("blocks").alias(blocks)
    )
    here = docs.join(
        gone, (F.col(id_col) == F.col(i)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(version)), "left"
    ).withColumn(lines, F.split(F.col(text), "\n", -1))
    stays = F.filter(lines, lambda _, k: F.forall(blocks, lambda b: (k < b["first"]) | (k > b["last"])))
    out = here.withColumn(kept, F.when(F.col(blocks).isNotNull(), stays))
    columns = [
        F.when(F.col(kept).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(c)).alias(c) if c == text else F.col(c)
        for c in docs.columns
    ]
    if report:
        n = F.coalesce(F.size(lines), F.lit(0))
        columns += [
            F.when(F.col(text).isNull(), 0).otherwise(n).alias("n_lines"),
            F.when(F.col(kept).isNull(), 0).otherwise(n - F.size(kept)).alias("n_deleted_lines"),
        ]
    return out.select(columns)
