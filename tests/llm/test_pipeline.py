import re

import corpus_pipeline as P
from pyspark.sql import functions as F

import hashlib

import sentencepiece

from pricetail.llm import quality_gbt, simhash_golay
from pricetail.llm._common import table
from pricetail.llm.queries import sentencepiece_model
from tests.llm import test_line_dedup, test_mixing, test_simhash_golay

DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = table(spark, DIR, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        after = stage(spark, docs, DIR)
        path = f"{tmp_path}/{k}"
        after.write.parquet(path)
        rows = spark.read.parquet(path)
        if k < len(P.STAGES) - 1:
            assert rows.columns == columns, name
            assert rows.filter(F.col("n_chars") != F.char_length("text")).count() == 0
        made = rows.collect()
        assert {r.doc_id for r in made} <= set(before), name
        if k == 0:
            trees = quality_gbt.fit(docs, table(spark, DIR, "labels"))
            scores = {r.doc_id: r.score for r in quality_gbt.classify(docs, trees).collect()}
            assert {r.doc_id for r in made} == {i for i, s in scores.items() if s >= quality_gbt.THRESHOLD}
        if k == 1:
            lines = [x for r in made for x in {y.strip() for y in (r.text or "").split("\n")} if len(x.split()) >= 25]
            assert len(lines) == len(set(lines))
            assert all(r.text is None or set(r.text.split("\n")) <= set(before[r.doc_id].split("\n")) for r in made)
        if k == 2:
            groups = {r.doc_id: r.component_id for r in simhash_golay.near_duplicates(docs).collect()}
            assert sorted(r.doc_id for r in made) == sorted({*groups.values()})
        if k == 3:
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
            whole = sum(size(t) for t in before.values())
            assert abs(sum(size(r.text) for r in made) - 1.5 * whole) < 30
        docs = rows
    assert {r.doc_id for r in docs.collect()} == set(before)


def test_run_equals_the_stages(spark):
    found = P.run(spark, DIR)
    docs = table(spark, DIR, "documents")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, DIR)
    key = lambda r: (r.doc_id, r.n_tokens, r.decoded_sha256)
    assert sorted(map(key, found.collect())) == sorted(map(key, docs.collect()))


def odd_tables(spark, folder):
    """Documents with nulls, empty and very long texts, repeated rows and columns named like those that stages add."""
    prose = table(spark, DIR, "documents").limit(40).select("doc_id", "text", "lang", "source", "n_chars").collect()
    rows = [tuple(r) for r in prose]
    long = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
    rows += [rows[0], rows[0], (9001, None, None, None, None), (9002, "", "en", "web", 0), (9003, " \n", None, None, 2), (None, None, None, None, None)]
    rows += [(9004, long, "en", "web", len(long)), (9005, rows[1][1], None, None, 5), (None, "alone in this table with no id", "en", None, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("*", "1 AS token_ids", "2 AS h", "3 AS score", "4 AS taken", "5 AS size").write.parquet(f"{folder}/documents.parquet")
    labels = table(spark, DIR, "labels").selectExpr("*").unionByName(spark.createDataFrame([(9001, None, None), (None, 1, 0)], table(spark, DIR, "labels").schema))
    labels.write.parquet(f"{folder}/labels.parquet")
    return rows


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_odd_rows(spark, tmp_path):
    rows = odd_tables(spark, tmp_path)
    docs = table(spark, str(tmp_path), "documents")
    near = P.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sum(r.doc_id is None for r in near) == 2
    assert sum(r.doc_id == rows[0][0] for r in near) == 3
    assert sum(not size(r.text) for r in near if r.doc_id is not None) == 1
    assert not any(r.doc_id == 9005 for r in near)
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        after.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        # The long text of words that no other has goes through whole or not at all.
        assert {size(r.text) for r in docs.filter("doc_id = 9004").collect()} <= {60_000, 120_000, *range(60_000)}
    found = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} <= {r[0] for r in rows}
    assert all(r.n_tokens >= 2 for r in found)


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, DIR, name).limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert P.run(spark, f"{tmp_path}/none").collect() == []
    table(spark, DIR, "documents").limit(30).write.parquet(f"{tmp_path}/unlabelled/documents.parquet")
    table(spark, DIR, "labels").limit(0).write.parquet(f"{tmp_path}/unlabelled/labels.parquet")
    docs = table(spark, f"{tmp_path}/unlabelled", "documents")
    assert P.quality(spark, docs, f"{tmp_path}/unlabelled").count() == 30


def test_run_equals_brute_force(spark):
    """Every stage again in plain Python, on the whole table."""
    docs = [(r.doc_id, r.text, r.source) for r in table(spark, DIR, "documents").collect()]
    trees = quality_gbt.fit(table(spark, DIR, "documents"), table(spark, DIR, "labels"))
    score = lambda t: float(trees.score(quality_gbt.np.array([quality_gbt.statistics((t or "").encode())]))[0])
    docs = [d for d in docs if score(d[1]) >= quality_gbt.THRESHOLD]
    lines = test_line_dedup.plain([d[:2] for d in docs], 25)
    docs = [(i, lines[i], s) for i, _, s in docs if size(lines[i]) or not size(dict((a, b) for a, b, _ in docs)[i])]
    groups = test_simhash_golay.plain_components([(i, test_simhash_golay.plain_fingerprint(t)) for i, t, _ in docs])
    docs = [d for d in docs if groups[d[0]] == d[0]]
    taken = {r[0]: r for r in test_mixing.plain(docs)}
    mixed = []
    for i, t, _ in docs:
        n, words = size(t), taken[i][-1]
        mixed += [(i, t)] * (words // n if n else 1)
        if n and words % n:
            ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
            mixed.append((i, t[: ends[words % n - 1]]))
    codec = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_model())
    want = []
    for i, t in mixed:
        ids = codec.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(codec.decode(ids).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in P.run(spark, DIR).collect()) == sorted(want)
