import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetail.llm import log_bilinear as L

SCHEMA = "doc_id long, text string, row long, word string, training string"


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    return L.language_scores(df, held, **options).collect()


def held_out(i):
    return zlib.crc32(str(i if i is not None else "").encode()) % 5 == 1


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def brute(rows):
    counts = Counter(w for i, text in rows if not held_out(i) for w in plain_words(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        found = plain_words(text)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in found)
        out.append((i, held_out(i), len(found), sum(counts[w] > 0 for w in found), n, base))
    return out


def check(spark, rows, **options):
    got = run(spark, rows, **options)
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(brute(rows), key=key), strict=True):
        assert tuple(a)[:5] == b[:5]
        assert a.base_score == pytest.approx(b[5], abs=1e-6)
        assert math.isfinite(a.score) and a.score < 0
    return got


def test_base_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    pool = [f"w{k}" for k in range(60)] + ["É", "Łx", "A b", "UP", "y" * 70, "Y" * 70]
    rows = [(i, rng.choice([" ", "\n", "\x0b\t"]).join(rng.choices(pool, k=rng.randrange(60)))) for i in range(80)]
    rows += [(100, None), (101, ""), (None, "w1 w2"), (7, rows[7][1]), (7, rows[7][1]), (103, "w3 " * 5000), (104, "one\x0ctwo\x1cthree")]
    check(spark, rows)
    # Few listed words and pieces of a few bytes: most words go through the join.
    monkeypatch.setattr(L, "LISTED", 30)
    monkeypatch.setattr(L, "PIECE", 50)
    check(spark, rows, classes=5)


def test_probabilities_add_up():
    rng = np.random.default_rng(2)
    model = L.initial(rng.integers(1, 50, 9).astype(float), 4)
    classes = np.array([3, 1, 2, 0, 1])
    sizes = np.array([2, 3])
    total = 0
    for k in range(9):
        changed = classes.copy()
        changed[4] = k
        total += np.exp(L.log_probabilities(model, changed, sizes)[4])
    assert total == pytest.approx(1, abs=1e-5)
    # Each text begins anew.
    alone = np.concatenate([L.log_probabilities(model, classes[:2], sizes[:1]), L.log_probabilities(model, classes[2:], sizes[1:])])
    assert np.allclose(L.log_probabilities(model, classes, sizes), alone, atol=1e-5)


def test_learns_word_order(spark):
    """On held-out texts of a chain of words the model beats single-word shares by far."""
    rng = random.Random(4)
    follow = {k: rng.sample(range(40), 2) for k in range(40)}
    rows = []
    for i in range(600):
        w, text = rng.randrange(40), []
        for _ in range(80):
            text.append(f"t{w}")
            w = rng.choice(follow[w])
        rows.append((i, " ".join(text)))
    got = [r for r in check(spark, rows) if r.held_out]
    score, base, tokens = (sum(getattr(r, c) for r in got) for c in ("score", "base_score", "n_tokens"))
    # 1.5 digits a token by shares alone; 0.3 is the chain's own entropy.
    assert base / tokens < -1.4
    assert score / tokens > -1.0, score / tokens
    shuffled = [(i, " ".join(rng.sample(t.split(), 80))) if held_out(i) else (i, t) for i, t in rows]
    mixed = sum(r.score for r in run(spark, shuffled) if r.held_out)
    assert mixed < score - 0.3 * tokens


def test_no_training_rows_and_no_rows(spark):
    alone = next(i for i in range(100) if held_out(i))
    [row] = check(spark, [(alone, "a b a")])
    assert (row.train_tokens, row.n_known, row.n_tokens) == (0, 0, 4)
    assert run(spark, []) == []
