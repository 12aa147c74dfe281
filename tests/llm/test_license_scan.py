import random
import re

import pytest
from pyspark.sql import functions as F

from pricetail.llm import license_scan as L


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def plain(rows, templates):
    out = set()
    for i in {i for i, _ in rows}:
        have = set().union(*[shingles(t) for k, t in rows if k == i])
        for name, text in templates.items():
            want = shingles(text)
            if len(have & want) / len(want) >= 0.8:
                out.add((i, name, len(have & want), len(want)))
    return out


def test_scan_equals_brute_force(spark):
    notices = L.NOTICES
    mit, apache = notices["mit"], notices["apache-2.0-header"]
    filler = " ".join(f"f{k}" for k in range(70))
    rows = [
        (1, None), (2, ""), (3, "four words are few"), (4, mit), (5, f"{filler} {apache} {filler}"), (6, mit.replace("free of charge", "at no charge")),
        (7, f"{filler} {notices['mit-line']}\n"), (8, f"a {notices['gpl-3.0-line'].upper()} b"), (9, " ".join(mit.split()[:30])),
        (10, filler * 50 + " " + mit + " " + apache), (11, mit), (11, apache), (12, notices["apache-2.0-line"] * 2), (None, mit), (13, apache.replace("\n", " ").replace(" ", "\t\n")),
    ]
    for k in range(60):
        # Passages that begin at any place of a window.
        rows.append((100 + k, " ".join(f"g{j}" for j in range(k)) + " " + list(notices.values())[k % len(notices)] + " tail"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS template", "3 AS id")
    found = L.scan(docs, L.notice_templates(docs)).collect()
    assert {(r.doc_id, r.template, r.shared, r.template_shingles) for r in found} == plain(rows, notices)
    assert L.scan(docs.limit(0), L.notice_templates(docs)).count() == 0
    assert L.scan(docs, L.notice_templates(docs).limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.scan(docs, spark.createDataFrame([("t", "too few")], "template string, text string"))


def test_damaged_templates_are_found(spark):
    """Recall of texts that hold 0.8 or more of a template: all up to 23 shingles, 0.99 above."""
    rng = random.Random(4)
    for size in (8, 20, 26, 40, 100):
        templates = {f"t{k}": " ".join(f"w{size}x{k}x{j}" for j in range(size + 4)) for k in range(40)}
        rows = []
        for k, text in templates.items():
            for _ in range(15):
                words = text.split()
                cut = int(rng.random() * 0.2 * size)
                words = words[cut:] if rng.random() < 0.5 else words[: len(words) - cut]
                if rng.random() < 0.5:
                    words[rng.randrange(len(words))] = "changed"
                before = [f"f{rng.random()}" for _ in range(rng.choice([0, 0, 5, 11, 40]))]
                rows.append((len(rows), " ".join(before + words + before[::-1])))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        frame = spark.createDataFrame(list(templates.items()), "template string, text string")
        found = {(r.doc_id, r.template, r.shared, r.template_shingles) for r in L.scan(docs, frame).collect()}
        want = plain(rows, templates)
        assert found <= want and len(want) > 200
        assert found == want if size < L.WINDOW else len(found) >= 0.99 * len(want)


def test_short_text_of_a_built_in_notice(spark):
    text = " ".join(L.NOTICES["gpl-3.0-line"].split()[:-1])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    [row] = L.scan(docs, L.notice_templates(docs)).collect()
    assert row.template == "gpl-3.0-line" and row.shared == row.template_shingles - 1


def test_joined_by_key_gives_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sent = sorted(L.scan(docs, L.notice_templates(docs)).collect())
    monkeypatch.setattr(L, "SENT_KEYS", 0)
    assert sorted(L.scan(docs, L.notice_templates(docs)).collect()) == sent


def test_no_python_on_the_path(spark, capsys):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    L.scan(docs, L.notice_templates(docs).select("template", F.col("text"))).explain()
    assert "Python" not in capsys.readouterr().out
