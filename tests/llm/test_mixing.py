import hashlib
import re

from pricetail.llm import mixing as M


def plain(rows, weights=(3, 1, 2), budget=1.5, epochs=2, seed="mix-1"):
    """Targets by pouring again and again, then a walk through each source in the order of keys."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), budget * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > epochs * total[s]}
        for s in full or free:
            target[s] = epochs * total[s] if full else level * weight[s]
            if full:
                left -= target[s]
        free = free - full if full else set()
    taken = []
    for s in sources:
        want = int(target[s] + 0.5)
        passes, rest = divmod(want, total[s]) if total[s] else (0, 0)
        key = lambda r: (hashlib.md5(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, size(r[1]))
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=key):
            n = size(t)
            some = min(n, rest)
            rest -= some
            taken.append((i, n, total[s], round(target[s], 6), n * passes + some))
    return taken


ROWS = [(i, "w " * (i * 7 % 23), f"s{i * i % 5}") for i in range(200)] + [
    (300, None, "s1"), (301, "", None), (302, "a b c", None), (303, "x " * 4000, "s2"), (304, "y", "S"), (304, "y", "S"), (None, "q q", "s0"),
]


def shown(frame):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in frame.collect()), key=repr)


def test_mix_equals_walk(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS taken", "3 AS key", "4 AS range")
    for settings in ({}, {"budget": 0.3}, {"budget": 9.0}, {"weights": (1, 100)}):
        found = M.mix(docs, **settings)
        assert shown(found) == sorted(plain(ROWS, **settings), key=repr)
        assert all(r.taken <= 2 * r.size for r in found.collect())
    assert shown(M.mix(docs)) == shown(M.mix(docs.repartition(7)))
    assert M.mix(docs.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.doc_id, r.taken) for r in M.mix(empty).orderBy("doc_id").collect()] == [(1, 0), (2, 0)]


def test_mixed_documents_hold_what_the_mix_takes(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", "1 AS mix_id", "2 AS mix_k")
    found = M.mixed_documents(docs)
    assert found.columns == docs.columns
    words, want = {}, {}
    for r in found.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
    for i, _, _, _, taken in plain(ROWS):
        want[i] = want.get(i, 0) + taken
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in want.items() if v}
    # Documents without a word stay once.
    assert {300, 301} <= set(words)
    assert M.mixed_documents(docs.limit(0)).count() == 0
