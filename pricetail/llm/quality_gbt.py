"""Quality classifier: gradient-boosted trees over statistics of a document.

The statistics of a text are numbers only (lengths, shares of character classes,
repetition); labels, language, source and id are no inputs.  Training takes a
sample of labelled rows of bounded size, whose statistics Spark computes; trees
grow on histograms of at most 64 bins.  The trees are flattened into arrays of
feature, threshold and children, which a batch of rows descends level by level in
numpy.

Defined results: null and empty texts have all statistics zero and are scored
like any other; very long texts are read whole; without labels of both kinds the
score is the share of label 1 (0.5 without any); repeated rows are scored
alike; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows with a remainder of 0 are held out.
FOLDS = 5
# Most labelled rows that training takes, in the order of a hash of the id.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "long_words", "lower", "upper", "digit", "space", "newline",
    "not_ascii", "comma_stop", "mark", "bar", "symbol", "other", "capital_words", "distinct_words", "repeats_next",
    "top_word", "distinct_lines", "line_words", "byte_entropy",
]

_CLASS = np.zeros((256, 11))
for _name, _bytes in enumerate(
    [
        range(97, 123), range(65, 91), range(48, 58), b" \t\r\x0b\x0c", b"\n", range(128, 256), b",.;:'\"-", b"!?", b"|",
        b"#*$%&<>@^~=+_\\/`", b"()[]{}",
    ]
):
    _CLASS[list(_bytes), _name] = 1


def statistics(text: bytes | None) -> list[float]:
    """The numbers of FEATURES for a UTF-8 text."""
    if not text:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(text)
    shares = (counts @ _CLASS / n).tolist()
    seen = counts[counts > 0] / n
    entropy = float(-(seen * np.log2(seen)).sum())
    words = text.split()
    m = len(words)
    if not m:
        return [np.log1p(n), 0.0, 0.0, 0.0, 0.0, *shares, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, entropy]
    lengths = np.fromiter(map(len, words), np.int64, m)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(lengths.mean()), float(lengths.std()), float((lengths > 20).mean()),
        *shares,
        sum(w[:1].isupper() for w in words) / m,
        len(tally) / m,
        sum(map(bytes.__eq__, words, words[1:])) / m,
        max(tally.values()) / m,
        len(set(lines)) / len(lines),
        float(np.log1p(m / len(lines))),
        entropy,
    ]


@dataclass
class Trees:
    """All trees in flat arrays; a leaf's children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Boosting with logistic loss on histograms of gradients."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []

    def add() -> int:
        k = len(nodes)
        nodes.append([0, 0.0, k, k, 0.0])
        return k

    if not 0 < y.sum() < len(y):
        rounds = 0
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])] if rounds else []
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if rounds else None
    width = bins + 1
    offsets = np.arange(x.shape[1]) * width
    margin = np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(add())
        level = [(roots[-1], np.arange(len(y)))]
        for d in range(depth + 1):
            nxt = []
            for node, rows in level:
                g, h = grad[rows].sum(), hess[rows].sum()
                best = None
                if d < depth and len(rows) >= 2 * least:
                    cells = (binned[rows] + offsets).ravel()
                    hist = [
                        np.bincount(cells, np.repeat(v, x.shape[1]), width * x.shape[1]).reshape(-1, width).cumsum(axis=1)[:, :-1]
                        for v in (grad[rows], hess[rows], np.ones(len(rows)))
                    ]
                    gl, hl, nl = hist
                    gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = -1
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[f, b] > 1e-6 and b < len(edges[f]):
                        best = int(f), int(b)
                if best is None:
                    nodes[node][4] = -rate * g / (h + ridge)
                    margin[rows] += nodes[node][4]
                    continue
                f, b = best
                to_left = binned[rows, f] <= b
                low, high = add(), add()
                nodes[node][:4] = [f, float(edges[f][b]), low, high]
                nxt += [(low, rows[to_left]), (high, rows[~to_left])]
            level = nxt
    flat = np.array(nodes, float).reshape(-1, 5)
    return Trees(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots, int), depth, base)


def held_out(id_col: str | Column) -> Column:
    """Whether a row is kept out of training: the checksum of its id is a multiple of five; a null id always is."""
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    return F.coalesce(remainder == 0, F.lit(True))


def text_statistics(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def measured(rows: pa.Array) -> pa.Array:
        return pa.array([statistics(t) for t in rows.to_pylist()], pa.list_(pa.float64()))

    return measured(text.cast("binary"))


def first_by_hash(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Rows whose key hashes below a threshold, at least ``limit`` of them where there are as many.

    The threshold is set for a fifth more than wanted and doubled until it is enough,
    so that a sort after it gets a few rows, not ``limit`` from every task.
    """
    n = rows.count()
    share = 1.2 * limit / max(n, 1)
    while share < 1:
        below = rows.filter(F.xxhash64(key) < F.lit(int(share * 2**64) - 2**63))
        if below.count() >= limit:
            return below
        share *= 2
    return rows


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Trees from at most ``rows`` labelled documents that aren't held out."""
    # A bounded number of ids: small enough to send to every task.
    known = labels.filter(F.col(label).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).alias("chosen_id"), F.col(label).cast("double").alias("chosen_label")
    )
    chosen = first_by_hash(known, "chosen_id", rows).orderBy(F.xxhash64("chosen_id"), "chosen_id", "chosen_label").limit(rows)
    found = (
        docs.select(F.col(id_col).alias("id"), F.col(text).alias("body"))
        .join(F.broadcast(chosen), F.col("id") == F.col("chosen_id"))
        .select("id", "chosen_label", text_statistics(F.col("body")).alias("x"))
        .orderBy(F.xxhash64("id"), "id", "x")
        .limit(rows)
        .collect()
    )
    x = np.array([r.x for r in found], float).reshape(len(found), len(FEATURES))
    return train(x, np.array([r.chosen_label for r in found], float))


def quality_score(text: Column, trees: Trees) -> Column:
    """Score from 0 to 1: higher means that label 1 is likelier."""

    @F.arrow_udf("double")
    def scored(rows: pa.Array) -> pa.Array:
        x = np.array([statistics(t) for t in rows.to_pylist()], float).reshape(len(rows), len(FEATURES))
        return pa.array(trees.score(x), pa.float64())

    return scored(text.cast("binary"))


def classify(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for every row."""
    return docs.select(
        F.col(id_col), held_out(id_col).alias("held_out"), quality_score(F.col(text), trees).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, trees: Trees, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with their own columns."""
    return docs.filter(quality_score(F.col(text), trees) >= threshold)
