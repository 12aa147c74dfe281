"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a random but fixed key, a hash of seed and id.  Within a source
the documents are put in the order of their keys: the leading hexadecimal digits
of a key name its range, ranges are sorted on their own, and sums over the ranges
before give every document the words that stand before it in its source.  A
source whose target is beyond its size is read in whole epochs first; the rest of
the target is cut exactly: documents before the cut are taken whole, the one
that holds it up to the cut.

Targets are shares of a budget by weight; a source can't be read more than
``epochs`` times, and what it can't take goes to the others by weight.

Defined results: null texts have size 0 and take nothing; a null source is a
source of its own, the last; an empty table gives an empty table; equal keys
(repeated ids) are ordered by id, size and text hash, and rows equal in all of
these are interchangeable.  A budget beyond all limits takes all limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, body, fresh, saved

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
EPOCHS = 2
SEED = "mix-1"
# Hexadecimal digits of a key that name its range: 4,096 ranges in a source.
DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def weighted_sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """(missing, source, source_size, target) from one row per source with source_size.

    Sources in code point order, null last, get the weights in turn.  The share
    of a source is the smaller of its limit and level times weight: with sources
    in order of limit by weight, those before a point take their limits, the rest
    share what is left, and the level is the smallest of these shares by weight
    that no later limit undercuts.
    """
    place = Window.orderBy("missing", "source")
    order = Window.orderBy("fill", "missing", "source")
    after = order.rowsBetween(0, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = (
        sizes.withColumn("weight", w)
        .withColumn("limit", F.col("source_size") * float(epochs))
        .withColumn("fill", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every) * float(budget))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(after))
    )
    # The first source, in this order, that its level doesn't fill: from there on all share by weight.
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "missing", "source", "level"))).over(every)
    return ranked.withColumn("cut", level["level"]).select(
        "missing", "source", "source_size",
        F.when(F.col("cut").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("cut") * F.col("weight"))).alias("target"),
    )


def sized(docs: DataFrame, id_col: str, text: str, source: str, seed: str) -> DataFrame:
    """Narrow rows: id, source, size, key and range; written once, as two steps read them."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return saved(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source).isNull().alias("missing"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
            word_count(F.col(text)).alias("size"),
            key.alias("key"),
            F.substring(key, 1, DIGITS).alias("range"),
            F.xxhash64(body(text)).alias("tie"),
        ),
        "sizes",
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = BUDGET,
    epochs: int = EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """(id, size, source_size, target, taken, tie) for every row of docs."""
    rows = sized(docs, id_col, text, source, seed)
    ranges = rows.groupBy("missing", "source", "range").agg(F.sum("size").alias("range_size"))
    ranges = saved(ranges, "ranges")
    sources = weighted_sources(
        ranges.groupBy("missing", "source").agg(F.sum("range_size").alias("source_size")), weights, budget, epochs
    )
    # At most 16 ** DIGITS rows in a source.
    earlier = Window.partitionBy("missing", "source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).join(sources, ["missing", "source"])
    within = (
        Window.partitionBy("missing", "source", "range").orderBy("key", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = F.floor(F.col("target") + 0.5).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    rest = whole - passes * F.col("source_size")
    start = F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    return (
        rows.join(offsets, ["missing", "source", "range"])
        .withColumn("start", start)
        .select(
            F.col("id").alias(id_col), "size", "source_size", "target",
            (F.col("size") * passes + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))).alias("taken"),
            "tie",
        )
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The documents as the mix reads them: once for each whole pass, and once cut after its last word taken.

    A document that the mix takes no word of goes, but one without any word stays as it is: it
    takes no room in any budget.
    """
    names = fresh(docs.columns, "mix_id", "mix_tie", "mix_size", "mix_taken", "mix_rows", "mix_part", "mix_k", "mix_k2")
    i, tie, size, taken, rows, part, k, k2 = names
    found = saved(
        mix(docs, id_col, text, source, **settings).select(
            F.col(id_col).alias(i), F.col("tie").alias(tie), F.col("size").alias(size), F.col("taken").alias(taken)
        ),
        "mixed",
    )
    same = F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(body(text)) == F.col(tie))
    per = found.groupBy(i, tie).agg(F.count("*").alias(rows), F.max(size).alias(size), F.max(taken).alias(taken))
    single = docs.join(per.filter(F.col(rows) == 1), same)
    # Rows equal in id and text take different numbers of words: the k-th of them meets the k-th share.
    repeated = docs.join(per.filter(F.col(rows) > 1).select(i, tie), same).withColumn(
        k, F.row_number().over(Window.partitionBy(i, tie).orderBy(F.monotonically_increasing_id()))
    )
    everyone = Window.partitionBy(i, tie)
    shares = found.withColumn(rows, F.count("*").over(everyone)).filter(F.col(rows) > 1).select(
        *[F.col(c).alias(f"{c}_s") for c in (i, tie)], size, taken,
        F.row_number().over(Window.partitionBy(i, tie).orderBy(F.desc(taken))).alias(k2),
    )
    repeated = repeated.join(
        shares, F.col(i).eqNullSafe(F.col(f"{i}_s")) & (F.col(tie) == F.col(f"{tie}_s")) & (F.col(k) == F.col(k2))
    )
    return _emitted(single, docs.columns, text, size, taken, part).unionByName(
        _emitted(repeated, docs.columns, text, size, taken, part)
    )


def _emitted(joined: DataFrame, columns: list[str], text: str, size: str, taken: str, part: str) -> DataFrame:
    passes = F.when(F.col(size) > 0, F.floor(F.col(taken) / F.col(size))).otherwise(1)
    rest = F.when(F.col(size) > 0, F.pmod(F.col(taken), F.when(F.col(size) > 0, F.col(size)))).otherwise(0)
    parts = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), passes.cast("int")),
        F.array_repeat(rest.cast("long"), (rest > 0).cast("int")),
    )
    return joined.withColumn(part, F.explode(parts)).select(
        *[
            F.when(F.col(part) < 0, F.col(c)).otherwise(first_words(F.col(c), F.col(part))).alias(c) if c == text else F.col(c)
            for c in columns
        ]
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, with the white space between as it is."""
    # Words and the white space before each, one after the other.
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), n.cast("int")), "")
