import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pricetail.llm import queries as Q
from pricetail.llm import token_shards as T


def test_permutation():
    for n in [1, 2, 3, 5, 16, 17, 1000, 4097]:
        slots = T.permuted(np.arange(n), n)
        assert sorted(slots.tolist()) == list(range(n))
    assert (T.permuted(np.arange(1000), 1000, 1) != T.permuted(np.arange(1000), 1000, 2)).any()
    assert np.abs(np.corrcoef(np.arange(5000), T.permuted(np.arange(5000), 5000))[0, 1]) < 0.05


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SHARD_RECORDS", 64)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = T.read_ranks(path)
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(None, None), (901, ""), (902, "<|endoftext|> x"), (902, "<|endoftext|> x"), (903, "w " * 30000)], "doc_id long, text string")
    )
    docs = docs.selectExpr("*", "1 AS tokens", "2 AS part", "3 AS id")
    ordered = T.training_order(docs, ranks, public_tokenizers.PATTERN)
    rows = ordered.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    made = {}
    for r in rows:
        record = np.frombuffer(r.record, "<u2")
        assert len(r.record) == T.STRIDE and record[0] == r.n_tokens and (record[1 + r.n_tokens :] == 50256).all()
        made.setdefault(r.doc_id, []).append((r.chunk, record[1 : 1 + r.n_tokens].tolist()))
    expected = {}
    for r in docs.collect():
        ids = plain.encode_ordinary(r.text or "") + [50256]
        expected.setdefault(r.doc_id, []).extend((k // 512, ids[k : k + 512]) for k in range(0, len(ids), 512))
    assert {k: sorted(v) for k, v in made.items()} == {k: sorted(v) for k, v in expected.items()}

    folder = f"file://{tmp_path}/shards"
    shards = T.write_shards(ordered, folder).collect()
    assert sum(s.records for s in shards) == len(rows) and all(s.records == 64 for s in sorted(shards)[:-1])
    by_slot = {r.slot: np.frombuffer(r.record, "<u2")[1 : 1 + r.n_tokens].tolist() for r in rows}
    # A reader that stopped goes on anywhere, over the ends of shards.
    got = [x.tolist() for x in T.read_slots(folder, 60, 10)]
    assert got == [by_slot[k] for k in range(60, 70)]
    assert T.training_order(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_query_writes_its_shards(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD_RECORDS", 64)
    shards = sorted(Q.QUERIES["op3_token_shards"](spark, "/root/testdata/sf0.001").collect())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ranks = T.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = sorted((r.slot, bytes(r.record)) for r in T.training_order(docs, ranks, public_tokenizers.PATTERN).collect())
    assert sum(s.records for s in shards) == len(rows) > 64 and all(s.records == 64 for s in shards[:-1])
    for s in shards:
        with open(s.file, "rb") as f:
            whole = f.read()
        assert whole == b"".join(r for _, r in rows[64 * s.shard : 64 * s.shard + 64])
        assert s.bytes == len(whole) and s.sha256 == hashlib.sha256(whole).hexdigest()


def test_odd_rows_either_way(spark, tmp_path):
    ranks = T.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = [(None, None), (1, ""), (2, "x"), (2, "x"), (3, "w " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [T.sharded(docs, ranks, public_tokenizers.PATTERN, f"file://{tmp_path}/{k}", again=k).collect() for k in (False, True)]
    assert [(s.shard, s.records, s.sha256) for s in got[0]] == [(s.shard, s.records, s.sha256) for s in got[1]]
    assert T.sharded(docs.limit(0), ranks, public_tokenizers.PATTERN, f"file://{tmp_path}/none", again=True).count() == 0
    lacking = T.training_order(docs, ranks, public_tokenizers.PATTERN).filter("slot <> 1")
    with pytest.raises(Exception, match="lacks a slot"):
        T.write_shards(lacking, f"file://{tmp_path}/lacking").collect()
