import hashlib
from collections import Counter

import numpy as np

from pricetail.llm import order_minhash as M


def plain_fingerprint(text):
    """Order MinHash from its definition, with the module's permutations."""
    b = text.encode()
    grams = [b[i : i + 8] for i in range(len(b) - 7)] or [b.ljust(8, b"\0")]
    seen, numbers = Counter(), []
    for g in grams:
        h = M._mixed(np.array([int.from_bytes(g, "little")], np.uint64)) + np.uint64(seen[g]) * M._ODD[2]
        seen[g] += 1
        numbers.append(int(M._mixed(h)[0]) >> 32)
    out = []
    for flip, times in zip(M._FLIP[:, 0].tolist(), M._TIMES[:, 0].tolist()):
        ranked = sorted(range(len(numbers)), key=lambda i: ((numbers[i] ^ flip) * times % (1 << 32), i))[:2]
        p, q = min(ranked), max(ranked)
        pair = M._mixed(np.array([numbers[p] << 32 | numbers[q]], np.uint64))
        out.append(max(1, int(pair[0]) >> 32))
    return out


def test_fingerprint_equals_definition():
    rng = np.random.default_rng(2)
    for text in ["a", "short", "12345678", "ab" * 60, "x" * 90, "é" * 20, "".join(rng.choice(list("abc "), 400))]:
        assert M.fingerprint(text).tolist() == plain_fingerprint(text)


def test_order_and_repeats_count():
    rng = np.random.default_rng(3)
    parts = ["".join(rng.choice(list("abcdefgh "), 300)) for _ in range(8)]
    text, moved = "".join(parts), "".join(reversed(parts))
    small = text[:1000] + "#" + text[1001:]
    assert M.likeness(M.fingerprint(text), M.fingerprint(text)) == 1
    assert M.likeness(M.fingerprint(text), M.fingerprint(small)) > M.likeness(M.fingerprint(text), M.fingerprint(moved))
    assert M.likeness(M.fingerprint("abcdefgh" * 20), M.fingerprint("abcdefgh" * 60)) < 0.9


def test_report_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 7)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).union(
        spark.createDataFrame([(-5, None), (900, ""), (901, "x"), (901, "y" * 40), (902, "z" * 5000)], "doc_id long, text string")
    )
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    expected = []
    for k, (i, t) in enumerate(rows):
        follow = rows[(k + 1) % len(rows)][1]
        changed = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        a, b, c = M.fingerprint(t), M.fingerprint(changed), M.fingerprint(follow)
        expected.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), M.shown(a), M.shown(b), float((a == b).mean()), float((a == c).mean())))
    wide = docs.selectExpr("doc_id", "text", "1 AS own", "2 AS id", "3 AS place")
    assert sorted(map(tuple, M.edit_report(wide).collect())) == sorted(expected)
    one = M.edit_report(docs.filter("doc_id = 901 AND length(text) = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert M.edit_report(docs.limit(0)).count() == 0
    gap = spark.createDataFrame([(None, "a" * 30), (None, "b" * 30), (3, "c")], "doc_id long, text string")
    assert M.edit_report(gap).count() == 3
