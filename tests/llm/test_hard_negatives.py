import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pricetail.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, a string, k string, packed string"


def brute(rows, every=50):
    """All scores, row by row."""
    kept = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    first = lambda found: sorted(found, key=lambda s: (-s[0], s[1] is None, s[1] or 0))
    out = []
    for n, (i, label, v) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(sum(p * q for p, q in zip(v, w)), j, other) for m, (j, other, w) in enumerate(kept) if m != n]
        for score, j, _ in first(s for s in scored if s[2] == label)[:5]:
            far = first(s for s in scored if s[2] != label and 50 * score <= 100 * s[0] <= 95 * score)[:3]
            out += [(i, j, r, k, score, s) for r, (s, k, _) in enumerate(far, 1)]
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in H.hard_negatives(df).collect()), key=repr)


def test_scores_are_inner_products():
    rng = np.random.default_rng(1)
    for dims, most in [(1, 3), (8, 200), (13, 1000), (64, 256)]:
        a, c = rng.uniform(-most, most, (2, 70, dims)) / 256
        digits = int(most + 1).bit_length() + 1
        packed = [np.frombuffer(b"".join(H.pack(pa.array(list(x), pa.list_(pa.float64())), digits, -(-dims // 8)).to_pylist()), "uint8") for x in (a, c)]
        pa_, pc = (p.reshape(70, digits, -1) for p in packed)
        whole = [np.floor(x * 256).astype(int) for x in (a, c)]
        assert (H.unpacked(pa_)[:, :dims] == whole[0]).all()
        assert (H.scores(H.subset_sums(H.unpacked(pa_), "int64"), pc) == whole[0] @ whole[1].T).all()


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "ANCHORS_A_CELL", 3)
    monkeypatch.setattr(H, "SCORED_ROWS", 7)
    monkeypatch.setattr(H, "TABLE_ANCHORS", 2)
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), [rng.choice([-0.3, 0.1, 0.2, 0.9]) for _ in range(5)]) for i in range(0, 400)]
    # Ties, twins (an anchor among them), a hot label, odd and short vectors.
    rows += [(1000 + i, 1, [0.5] * 5) for i in range(60)]
    rows += [(50, *rows[50][1:])] * 2 + [(50, 1, [0.9] * 5), (None, 2, [0.9] * 5), (450, 2, [0.9]), (500, 1, [])]
    rows += [(550, None, [0.1] * 5), (600, 1, None), (650, 1, [None] * 5), (700, 1, [float("nan")] * 5), (750, 1, [float("inf")] * 5)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert got


def test_large_components_and_small_tables(spark):
    rows = [(i * 25, i % 2, [1000.0 * i, -3.5, 70000.25]) for i in range(9)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, 1, [1.0])]) == []
    assert run(spark, []) == []


def test_anchor_chosen_by_caller(spark):
    rows = [(i, i % 2, [1.0, i / 10]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r.anchor_id for r in H.hard_negatives(df, F.col("vec_id") == 4).collect()}
    assert got <= {4}
