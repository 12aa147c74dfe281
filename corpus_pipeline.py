"""The corpus pipeline: each stage is written and read again as the next one's documents.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of
documents.  The quality classifier, line dedup and tokens run Python in Spark's
tasks and the training of the classifier has no SQL form, so run() has no SQL
either; tests compare the stages with brute-force versions.

Near duplicates follow the fingerprint's rule: three-word shingles, at most three
differing bits; no word likeness is checked beside it.

Defined results: a null text is scored like an empty one and stays null; texts
without words are near duplicates of each other; rows with a null id have no
copies and stay, and rows that repeat an id are kept beside each other; texts of
any length are worked on whole; a null source is a source of its own; tables
without rows give none, and without labels no document is rejected.  Other
columns may have any name and go through up to the last stage, which returns its
own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetail.llm import line_dedup, mixing, quality_gbt, sentencepiece_codec, simhash_golay
from pricetail.llm._common import saved, table
from pricetail.llm.queries import sentencepiece_model

ORACLE_SQL = None
# Words that a worker remembers in the last stage: workers outlive it, and other stages share their memory.
TOKEN_MEMO = 50_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    trees = quality_gbt.fit(docs, table(spark, sf_dir, "labels"))
    return quality_gbt.accepted(docs, trees)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without blocks that an earlier one has; a document left without a word goes."""
    kept = line_dedup.dedup_lines(docs, report=True)
    emptied = (F.col("n_deleted_lines") > 0) & (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")) == 0)
    return with_length(kept.filter(~emptied).select(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return simhash_golay.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources reads them."""
    return with_length(mixing.mixed_documents(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a check that they decode to its text."""
    model = sentencepiece_codec.read_model(sentencepiece_model())
    ids = docs.select("doc_id", "source", sentencepiece_codec.encoded(F.col("text"), model, TOKEN_MEMO).alias("token_ids"))
    return ids.select(
        "doc_id", "source", "token_ids", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(sentencepiece_codec.decoded(F.col("token_ids"), model, TOKEN_MEMO), 256).alias("decoded_sha256"),
    )


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where the table has it."""
    return docs.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources", mix),
    ("SentencePiece tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{k}")
    return docs
