import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from pricetail.llm import sentencepiece_codec as C

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    model = C.read_model(PATH)
    return C.PieceCodec(model), sentencepiece.SentencePieceProcessor(model_proto=model)


POOL = [" ", "  ", "a", "e", "the", "\n", "\t", "é", "ñ", "日", "本", "한", "😀", "\x00", "▁", "<s>", "ß", "0", "12", ".", "...", "----", "ing", "tion", "​", "Z", "퟿", " " * 16, "    "]


def test_random_texts_equal_the_library(both):
    codec, library = both
    rng = random.Random(6)
    for _ in range(8000):
        text = "".join(rng.choice(POOL) for _ in range(rng.randint(0, 25)))
        ids = library.encode(text, add_bos=True, add_eos=True)
        made = codec.encode(text)
        assert np.frombuffer(made, "<u4").tolist() == ids
        assert codec.decode(made) == library.decode(ids)


def test_parts_searched_together_equal_the_library(both, monkeypatch):
    _, library = both
    # Few slots for pairs, small lots and small memos: all of them start anew in between.
    monkeypatch.setattr(C, "PAIR_SLOTS", 1 << 6)
    monkeypatch.setattr(C, "TOGETHER", 3000)
    monkeypatch.setattr(C, "MEMO_ENTRIES", 500)
    codec = C.PieceCodec(C.read_model(PATH))
    rng = random.Random(8)
    pieces = [codec.pieces[i] for i in range(260, 32000)]
    texts = [None, "", "\0", "a\0b", "x" * 70 + "日\n" * 40]
    for _ in range(8000):
        texts.append("".join(rng.choice(POOL) if rng.random() < 0.4 else rng.choice(pieces) for _ in range(rng.randint(0, 14))))
    for text, made in zip(texts, codec.encode_all(texts), strict=True):
        assert np.frombuffer(made, "<u4").tolist() == library.encode(text or "", add_bos=True, add_eos=True)
    assert codec.encode_all([]) == []


def test_random_ids_decode_like_the_library(both):
    codec, library = both
    rng = random.Random(7)
    for _ in range(3000):
        ids = [rng.choice([1, 2, 0, 259, 264, 28705, rng.randrange(32000), rng.randrange(3, 259)]) for _ in range(rng.randint(0, 9))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_memos_may_start_anew(both, monkeypatch):
    monkeypatch.setattr(C, "MEMO_ENTRIES", 20)
    codec, library = both
    text = " ".join(f"w{k}ord, {k}ing!" for k in range(300))
    assert np.frombuffer(C.PieceCodec(C.read_model(PATH)).encode(text), "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_documents(spark, both):
    _, library = both
    rows = [(1, None), (2, ""), (3, "a  b "), (3, "a  b "), (4, "long " * 40000), (5, "x" * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS pieces")
    found = C.decode_documents(C.encode_documents(docs, PATH), PATH).collect()
    assert len(found) == len(rows)
    for r in found:
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.token_ids, "<u4").tolist() == ids and r.decoded == library.decode(ids)
    assert C.encode_documents(docs.limit(0), PATH).count() == 0


def test_batches_become_objects_in_bounded_slices():
    rows = pa.array(["a" * 40, None, "", "b" * 500, "c" * 60, "d" * 30, "e"])
    parts = list(C._slices(rows, 100))
    assert pa.concat_arrays(parts).equals(rows) and [len(p) for p in parts] == [3, 1, 3]
    assert list(C._slices(rows.slice(0, 0), 100)) == []
