import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetail.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, n1 long, place string, size string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(role, text) for *_, role, text in sorted(x)] for c, x in convs.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for seq in members:
        if seq:
            kids[seq[:-1]].append(seq)
    out = []
    for seq, ids in members.items():
        below = [s for s in members if s[: len(seq)] == seq]
        ends = ",".join(map(str, sorted(c for c in ids if len(whole[c]) == len(seq))))
        out.append(
            (min(ids), len(seq), min(members[seq[:-1]]) if seq else None, len(ids), len(kids[seq]), sum(not kids[s] for s in below),
             sum((len(members[s]) - 1) * (len(s[-1][1]) if s else 0) for s in below), hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    c = F.col("conv_id")
    trie = P.prefix_trie(P.memberships(*P.rebuilt(P.ordered_turns(df), c - c % 100, F.crc32(c.cast("string")) % 6, 5)))
    return sorted((tuple(r) for r in trie.select(COLUMNS).collect()), key=repr)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(700), 60):
        # Few texts, so that many prefixes are shared; some conversations are copies.
        kind = c % 3
        rows += [(c, t, "user" if t % 2 == 0 else None, (["a", "bé", ""] if kind else ["same"])[rng.randrange(3 if kind else 1)]) for t in range(rng.choice([1, 2, 7, 12]))]
    rows += [(100, None, "user", None), (100, None, "user", "z"), (100, 3, None, "z"), (100, 3, None, "z"), (None, 1, "user", "a")]
    return rows


def test_against_brute_force(spark):
    rows = conversations(1)
    got = run(spark, rows)
    assert got == brute(rows)
    assert run(spark, []) == []


def test_split_by_joins(spark, monkeypatch):
    """Tiny limits: most components are split by joins, conversations in chunks."""
    monkeypatch.setattr(P, "CHUNK", 2)
    monkeypatch.setattr(P, "COMPONENT_ROWS", 60)
    rows = [r for r in conversations(2) if r[0] is None or r[0] < 300] + [(205, t, "user", "long " + str(t)) for t in range(40)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "broom"])
def test_roll_up(shape):
    rng = np.random.default_rng(5)
    n = 500
    if shape == "chain":
        parent = np.arange(n) - 1
    elif shape == "star":
        parent = np.where(np.arange(n) == 0, -1, 0)
    elif shape == "broom":
        parent = np.where(np.arange(n) < 250, np.arange(n) - 1, 249)
    else:
        parent = np.array([-1, -1] + [rng.integers(0, i) for i in range(2, n)])
    depth, own = np.zeros(n, dtype=int), rng.integers(1, 5, n)
    weight, wanted = own.copy(), np.arange(n)
    for i in range(n):
        depth[i] = 0 if parent[i] < 0 else depth[parent[i]] + 1
    plain = wanted.copy()
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            weight[parent[i]] += weight[i]
            plain[parent[i]] += plain[i]
    [got] = P.roll_up(parent, depth, weight, [wanted])
    assert (got == plain).all()


def test_long_text_and_extra_types(spark):
    rows = [(1, 0, "user", "x" * 300_000), (1, 1, "user", "y"), (2, 0, "user", "x" * 300_000)]
    assert run(spark, rows) == brute(rows)
