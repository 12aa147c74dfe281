import re

import numpy as np
import xxhash

from pricetail.llm import simhash_golay as S


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """{id: smallest reachable id} by comparing all fingerprints."""
    prints = sorted({fp for _, fp in rows})
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for i, fp in rows:
        r = root(fp)
        least[r] = min(i, least.get(r, i))
    return {i: least[root(fp)] for i, fp in rows}


def test_fingerprint_edges():
    for text in [None, "", " \t", "a", "A b", "a b c", "É A\x0bb c\x0cD e", "x " * 300, "w\xa0x y z"]:
        assert S.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_golay_keys_cover_two_errors():
    near = S.near_codewords()
    rng = np.random.default_rng(3)
    for _ in range(3000):
        a = int(rng.integers(1 << 16))
        b = a
        for bit in rng.choice(16, size=int(rng.integers(3)), replace=False):
            b ^= 1 << int(bit)
        assert set(near[a]) & set(near[b])
    assert max(map(len, near)) <= 6 and min(map(len, near)) >= 1


def test_components_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    prints = set()
    for _ in range(40):
        fp = int(rng.integers(1 << 63))
        for _ in range(int(rng.integers(1, 12))):
            prints.add(fp)
            for bit in rng.choice(64, size=int(rng.integers(1, 5)), replace=False):
                fp ^= 1 << int(bit)
    prints = sorted(prints)
    frame = spark.createDataFrame([(fp - (fp >> 63 << 64),) for fp in prints], "fp long")
    expected = plain_components([(i, fp) for i, fp in enumerate(prints)])
    from pricetail.llm.components import components

    # Blocks of two: keys with several fingerprints are dealt over many groups.
    for block in (2, S.BLOCK):
        parts = {r.node & (1 << 64) - 1: r.part & (1 << 64) - 1 for r in components(S.links(frame, block)).collect()}
        same = {}
        for i, fp in enumerate(prints):
            same.setdefault(parts.get(fp, fp), set()).add(expected[i])
        assert all(len(v) == 1 for v in same.values())
        assert len(same) == len(set(expected.values()))


def test_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(9001, None), (9002, ""), (9003, "\n \t"), (9004, "one two"), (9004, "one two")], "doc_id long, text string")
    )
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    found = S.near_duplicates(docs.selectExpr("doc_id", "text", "1 AS fp", "2 AS key", "3 AS id")).collect()
    assert len(found) == len(rows)
    prints = {i: f"{plain_fingerprint(t):016x}" for i, t in rows}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found} == {(i, prints[i], expected[i]) for i, _ in rows}
    kept = [r.doc_id for r in S.one_of_each(docs).collect()]
    assert sorted(kept) == sorted(i for i, _ in rows if expected[i] == i)
    assert S.near_duplicates(docs.limit(0)).count() == 0
