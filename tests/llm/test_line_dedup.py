import random

from pyspark.sql import functions as F

from pricetail.llm import line_dedup as L


def test_patience_is_an_alignment():
    rng = random.Random(4)
    for _ in range(500):
        a = [rng.randrange(8) for _ in range(rng.randrange(12))]
        b = [rng.randrange(8) for _ in range(rng.randrange(12))]
        pairs = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        if a == b:
            assert len(pairs) == len(a)
    assert L.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    # Lines that both have once are fixed first, in the longest shared order.
    assert L.patience([1, 2, 3, 4], [3, 4, 1, 2, 5]) in ([(0, 2), (1, 3)], [(2, 0), (3, 1)])
    assert L.patience([5, 1, 5], [5, 5, 1, 5]) == [(0, 0), (1, 2), (2, 3)]


def plain(rows, min_words):
    """All pairs of documents that share a run, aligned on whole line lists."""
    docs = sorted((i, [(k, x.strip(" \t\r\x0b\x0c"), len(x.split())) for k, x in enumerate(t.split("\n")) if x.split()]) for i, t in rows if t)

    def runs(lines):
        out = set()
        for s in range(len(lines)):
            n, run = 0, []
            for _, x, w in lines[s:]:
                run.append(x)
                n += w
                if n >= min_words:
                    out.add(tuple(run))
                    break
        return out

    first = {}
    for i, lines in docs:
        for r in runs(lines):
            first.setdefault(r, i)
    by_id = dict(docs)
    gone = {}
    for i, lines in docs:
        for partner in {first[r] for r in runs(lines)} - {i}:
            early = by_id[partner]
            rest = lines
            while rest:
                a = [k for k, (_, x, _) in enumerate(early) if x in {y for _, y, _ in rest}]
                b = [k for k, (_, x, _) in enumerate(lines) if lines[k] in rest and x in {y for _, y, _ in early}]
                pairs = L.patience([early[k][1] for k in a], [lines[k][1] for k in b])
                block, cut = [], set()
                for p, q in [(a[p], b[q]) for p, q in pairs] + [(-9, -9)]:
                    if block and (p, q) != (block[-1][0] + 1, block[-1][1] + 1):
                        if sum(lines[y][2] for _, y in block) >= min_words:
                            cut.update(range(lines[block[0][1]][0], lines[block[-1][1]][0] + 1))
                        block = []
                    block.append((p, q))
                if not cut:
                    break
                gone.setdefault(i, set()).update(cut)
                rest = [x for x in rest if x[0] not in cut]
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) if t else t for i, t in rows}


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    passage = "\n".join(" ".join(f"p{k}{j}" for j in range(9)) for k in range(6))
    extra = [
        (7001, None), (7002, ""), (7003, "  \n\n"), (7004, "short line\nshort line"),
        (7005, f"alpha\n{passage}\nomega"), (7006, f"beta beta\n\n{passage}"), (7007, passage), (7008, passage.replace("p2", "q2")),
        (7009, "\n".join(["again and again"] * 40)), (7010, "\n".join(["again and again"] * 30)), (7011, passage.replace("\n", "\r\n\n")),
        (7012, "\n".join(reversed(passage.split("\n")))), (7013, "\n".join(passage.split("\n")[3:] + ["between"] + passage.split("\n")[:3])),
    ]
    docs = docs.union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for min_words in (8, 25):
        expected = plain(rows, min_words)
        wide = docs.select("doc_id", "text", F.lit(1).alias("ID"), F.lit(2).alias("blocks"), F.lit(3).alias("version"))
        found = L.dedup_lines(wide, min_words=min_words)
        assert found.columns == wide.columns
        assert {r.doc_id: r.text for r in found.collect()} == expected
    assert {r.doc_id: r.text for r in found.collect()}[7007] == ""
    # Repeated ids, null ids and empty tables.
    odd = spark.createDataFrame([(1, passage), (1, passage), (None, passage), (2, passage + "\nend"), (2, passage + "\nend")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in L.dedup_lines(odd).collect()) == [(0, passage), (1, passage), (1, passage), (2, "end"), (2, "end")]
    assert L.dedup_lines(odd.limit(0)).count() == 0


def run_left(early, late, gone, words, min_words):
    """Whether a run of min_words words that stands in both is left of late, by looking at all pairs of places."""
    for i in range(len(early)):
        for j in range(len(late)):
            n = k = 0
            while i + k < len(early) and j + k < len(late) and early[i + k] == late[j + k] and j + k not in gone:
                n, k = n + words[early[i + k]], k + 1
            if n >= min_words:
                return True
    return False


def in_a_run(early, late, words, min_words):
    """Places of late that some run of min_words words, which early has too, covers."""
    out = set()
    for i in range(len(early)):
        for j in range(len(late)):
            n = k = 0
            while i + k < len(early) and j + k < len(late) and early[i + k] == late[j + k]:
                n, k = n + words[early[i + k]], k + 1
            if n >= min_words:
                out.update(range(j, j + k))
    return out


def test_no_run_is_left():
    def gone(early, late, words, min_words):
        both = sorted(set(early) & set(late))
        shared = [
            {"words": words[x], "early": [p for p, y in enumerate(early) if y == x], "late": at, "line": at}
            for x in both for at in [[p for p, y in enumerate(late) if y == x]]
        ]
        return {k for a, b, _ in L.common_blocks(shared, min_words) for k in range(a, b + 1)}

    words = {"P": 60, "Q": 30, "a": 2, "b": 3, "s": 4, "x": 5, "y": 1, "u": 9, "v": 12}
    assert gone("Payb", "axbP", words, 25) == {3}
    assert gone("Ps", "sxP", words, 25) == {2}
    # P stands alone in the first but for its neighbour s: both go where they are together.
    assert gone("PsPs", "sPsP", words, 25) == {0, 1, 2, 3}
    rng = random.Random(5)
    for _ in range(3000):
        early, late = (["".join(rng.choice("PQabsxyuv"[: rng.randint(3, 9)]) for _ in range(rng.randint(0, 12)))][0] for _ in range(2))
        cut = gone(early, late, words, 25)
        assert not run_left(early, late, cut, words, 25)
        assert cut <= in_a_run(early, late, words, 25)


def test_moved_line_goes(spark):
    long = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, f"{long}\nshort"), (2, f"short\nother\n{long}")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in L.dedup_lines(docs).collect()} == {1: f"{long}\nshort", 2: "short\nother"}
