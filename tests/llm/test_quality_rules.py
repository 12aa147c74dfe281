import math
import random
import re
from collections import Counter

from pricetail.llm import quality_rules as Q

WORD = r"[^\x20\x09-\x0D]+"


def plain_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def plain_histograms(text, lang):
    text = text or ""
    words = re.findall(WORD, text)
    classes = [len(re.findall(p, text)) for p in ("[a-z]", "[A-Z]", "[0-9]")] + [len(text) - sum(map(len, words)), len(re.findall(r"[^\x00-\x7F]", text))]
    common = [sum(w.lower() == c for w in words) for c in Q.COMMON_WORDS[lang]] if lang in Q.COMMON_WORDS else None
    return (classes, len(text)), (common, len(words))


def plain_distance(a, b):
    p, q = ([max(0, x) / n for x in [*h, n - sum(h)]] for h, n in (a, b))
    total = sum(x * math.log2(2 * x / (x + y)) for x, y in zip(p, q) if x) + sum(y * math.log2(2 * y / (x + y)) for x, y in zip(p, q) if y)
    return math.sqrt(max(total / 2, 0))


def rows():
    rng = random.Random(3)
    pool = ["the", "of", "The", "and", "x", "yy", "###", "A|B", "é", "12", "und", "der"]
    out = [
        (1, None, "en"), (2, "", "en"), (3, " \n\t", None), (4, "a b c", "en"), (5, "a a a a a a", "xx"), (6, "one two " * 6000, "de"),
        (7, "same line\nsame line\n\nsame line\r", "en"), (7, "same line\nsame line\n\nsame line\r", "en"), (8, " lead\x0btrail\x0c", "fr"), (9, "w\xa0x y z " * 30, None),
    ]
    for k in range(80):
        text = "".join(rng.choice(pool) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(rng.randint(1, 400)))
        out.append((100 + k, text, rng.choice(["en", "de", "fr", "es", None, "it"])))
    return out


def test_rules_equal_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").selectExpr("*", "1 AS c", "2 AS id", "3 AS n_words", "4 AS language")
    found = Q.quality_rules(docs).collect()
    assert len(found) == len(data)
    all_of = {}
    for _, t, lang in data:
        (c, n), (w, m) = plain_histograms(t, lang)
        have = all_of.setdefault(lang, [[0] * 5, 0, [0] * Q.SLOTS, 0])
        have[0] = [a + b for a, b in zip(have[0], c)]
        have[1] += n
        have[2] = [a + b for a, b in zip(have[2], w or have[2])] if w else have[2]
        have[3] += m
    by_id = {r.doc_id: r for r in found}
    for i, t, lang in data:
        r = by_id[i]
        counts = plain_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        (c, n), (w, m) = plain_histograms(t, lang)
        have = all_of[lang]
        far = plain_distance((c, n), (have[0], have[1])) if n >= Q.LEAST_CHARS else None
        other = plain_distance((w, m), (have[2], have[3])) if w and m >= Q.LEAST_COMPARED_WORDS else None
        for got, want in ((r.char_distance, far), (r.word_distance, other)):
            assert (got is None) == (want is None) and (want is None or abs(got - want) < 2e-6)
        assert r.base_failed == failed
        assert r.kept == (not failed and (far or 0) <= Q.MOST_CHAR_DISTANCE and (other or 0) <= Q.MOST_WORD_DISTANCE)
    assert Q.quality_rules(docs.limit(0)).count() == 0


def test_labels_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    found = [(truth[r.doc_id], r.kept) for r in Q.quality_rules(docs).collect() if r.doc_id in truth and not r.base_failed]
    good, bad = [k for q, k in found if q], [k for q, k in found if not q]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.4
