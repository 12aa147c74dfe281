"""Quality rules with distribution divergence, in DataFrame operations only.

Counts of a text (words, symbols, repeated lines and words) give the base rules.
Beyond them a text's histograms of character classes and of the common words of
its language are compared with those of all texts of the language, which one
aggregate gathers.  The measure is the Jensen-Shannon distance, the root of the
divergence in bits, from 0 to 1.  Short texts give no stable histogram, so each
comparison has a least length.

Defined results: null and empty texts have no words and fail; texts of any length
are counted whole; a null language is a language of its own; a language without a
list has the character comparison only; repeated rows are judged alike; an empty
table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import body, saved

# Frequent function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "with"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "den", "mit", "auf", "für", "sich"],
    "fr": ["le", "la", "de", "et", "les", "des", "un", "une", "est", "en", "que", "pour"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "las", "por", "con", "para"],
}
SLOTS = 12
CLASSES = ["lower", "upper", "digit", "space", "not_ascii", "other"]
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
# Comparisons need this much text, and reject beyond this distance.
LEAST_CHARS, MOST_CHAR_DISTANCE = 200, 0.28
LEAST_COMPARED_WORDS, MOST_WORD_DISTANCE = 100, 0.25
_SPACES = " \t\n\x0b\f\r"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluates value once and uses it, also where a lambda would evaluate it for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    inner = F.trim(text, F.lit(_SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+", -1))


def repeated_words(words: Column) -> Column:
    """Number of words that stand in a window of three found twice or more in the array."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda k: F.xxhash64(F.get(words, k), F.get(words, k + 1), F.get(words, k + 2)),
    )

    def twice(ranked: Column) -> Column:
        # Sorted by hash, then place, equal windows stand side by side.
        return F.filter(
            ranked,
            lambda x, k: F.get(ranked, k - 1)["h"].eqNullSafe(x["h"]) | F.get(ranked, k + 1)["h"].eqNullSafe(x["h"]),
        )

    def covered(places: Column) -> Column:
        # A window adds three words, or fewer if the next one begins within them.
        gaps = F.transform(places, lambda p, k: F.least(F.coalesce(F.get(places, k + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        places = let(ranked, lambda r: F.array_sort(F.transform(twice(r), lambda x: x["k"])))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(places, covered))

    return F.when(F.size(words) < 3, 0).otherwise(let(windows, count))


def text_counts(text: Column, lang: Column) -> Column:
    """Everything that is counted in a text, as one struct."""
    n = F.char_length(text)

    def without(pattern: str) -> Column:
        return n - F.char_length(F.regexp_replace(text, pattern, ""))

    lists = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    common = F.try_element_at(lists, lang)

    def slots(found: Column, of: Column) -> list[Column]:
        def slot(word: Column) -> Column:
            return F.size(F.filter(found, lambda w: w == word))

        return [slot(F.get(of, F.lit(k))) for k in range(SLOTS)]

    def counted(words: Column) -> Column:
        line_list = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        word_chars = F.char_length(F.array_join(words, ""))
        classes = [without("[a-z]+"), without("[A-Z]+"), without("[0-9]+"), n - word_chars, without(r"[^\x00-\x7F]+")]
        hits = let(common, lambda of: let(F.filter(F.transform(words, F.lower), lambda w: F.array_contains(of, w)), lambda m: F.array(*slots(m, of))))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            word_chars.cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(line_list, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            n.alias("chars"),
            F.array(*classes).cast("array<bigint>").alias("classes"),
            F.when(common.isNotNull(), hits).cast("array<bigint>").alias("common"),
        )

    return let(words_of(text), counted)


def distance(counts: Column, total: Column, reference: Column, reference_total: Column) -> Column:
    """Jensen-Shannon distance of two histograms; what the bins leave of a total is one more bin."""

    def shares(c: Column, t: Column) -> Column:
        rest = t - F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.transform(F.concat(c, F.array(rest.cast("bigint"))), lambda x: F.greatest(x, F.lit(0)) / t)

    def half(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(F.lit(2.0) * p / (p + q))).otherwise(0.0)

    bits = F.zip_with(shares(counts, total), shares(reference, reference_total), lambda p, q: half(p, q) + half(q, p))
    return F.sqrt(F.greatest(F.aggregate(bits, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts, both distances and the verdict for every row."""
    counted = saved(
        docs.select(F.col(id_col).alias("id"), F.col(lang).cast("string").alias("lang"), text_counts(body(text), F.col(lang).cast("string")).alias("c")).select(
            "id", "lang", "c.*"
        ),
        "counts",
    )
    # One row for each language: what all its texts hold together.
    reference = counted.groupBy(F.col("lang").alias("language")).agg(
        F.array(*[F.sum(F.get("classes", F.lit(k))) for k in range(len(CLASSES) - 1)]).alias("all_classes"),
        F.sum("chars").alias("all_chars"),
        F.array(*[F.sum(F.get("common", F.lit(k))) for k in range(SLOTS)]).alias("all_common"),
        F.sum("n_words").alias("all_words"),
    )
    chars = F.when((F.col("chars") >= LEAST_CHARS) & (F.col("all_chars") > 0), distance(F.col("classes"), F.col("chars"), F.col("all_classes"), F.col("all_chars")))
    words = F.when(
        (F.col("n_words") >= LEAST_COMPARED_WORDS) & F.col("common").isNotNull(),
        distance(F.col("common"), F.col("n_words"), F.col("all_common"), F.col("all_words")),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (
        counted.join(reference, F.col("lang").eqNullSafe(F.col("language")))
        .withColumns({"char_distance": chars, "word_distance": words})
        .withColumn("base_failed", failed)
        .select(
            F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (
                ~F.col("base_failed")
                & (F.coalesce("char_distance", F.lit(0.0)) <= MOST_CHAR_DISTANCE)
                & (F.coalesce("word_distance", F.lit(0.0)) <= MOST_WORD_DISTANCE)
            ).alias("kept"),
            F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"),
        )
    )
