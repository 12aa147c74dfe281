import zlib

import numpy as np

from pricetail.llm import quality_gbt as Q


def test_flat_trees_learn_and_agree_with_walks():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = Q.train(x[:2000], y[:2000])
    score = trees.score(x[2000:])
    assert ((score > 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        total = trees.base
        for k in trees.roots:
            while trees.left[k] != k:
                k = trees.left[k] if row[trees.feature[k]] <= trees.threshold[k] else trees.right[k]
            total += trees.value[k]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(score[:50], [walk(r) for r in x[2000:2050]])


def test_one_kind_of_label_gives_its_share():
    assert np.allclose(Q.train(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))), 0.5)
    assert (Q.train(np.zeros((9, 3)), np.ones(9)).score(np.zeros((2, 3))) > 0.99).all()


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    trees = Q.fit(docs, labels)
    extra = spark.createDataFrame([(9001, None), (9002, ""), (None, "x"), (9003, "many words " * 30000), (9003, "many words " * 30000)], "doc_id long, text string")
    found = Q.classify(docs.union(extra).selectExpr("*", "1 AS score", "2 AS x", "3 AS lang"), trees).collect()
    assert len(found) == docs.count() + 5
    truth = {r.doc_id: r.quality for r in labels.collect()}
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    scored = [(r.predicted, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    assert len(scored) > 40 and np.mean([a == b for a, b in scored]) > 0.95
    assert {r.score for r in found if r.doc_id in (9001, 9002)}.__len__() == 1
    assert Q.classify(docs.limit(0), trees).count() == 0
    assert Q.fit(docs, labels.limit(0)).score(np.zeros((1, len(Q.FEATURES))))[0] == 0.5


def test_label_sample_is_the_first_by_hash(spark):
    rows = spark.range(5000).union(spark.range(7, 8)).selectExpr("id AS k", "xxhash64(id) AS h")
    for limit in (0, 10, 900, 4800, 9000):
        some = Q.first_by_hash(rows, "k", limit)
        assert some.orderBy("h", "k").limit(limit).collect() == rows.orderBy("h", "k").limit(limit).collect()
        assert some.count() <= 1.5 * limit + 20 or limit >= 4800
    # One id with a third of all rows: the threshold is widened until there are enough.
    hot = rows.union(spark.sql("SELECT 3 AS k, xxhash64(3L) AS h FROM range(2500)"))
    assert Q.first_by_hash(hot, "k", 3000).count() >= 3000
    assert Q.first_by_hash(rows.limit(0), "k", 5).count() == 0
