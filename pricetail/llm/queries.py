"""One registered query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ._common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def sentencepiece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op8_sentencepiece_codec")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import decoded, encoded, read_model

    model = read_model(sentencepiece_model())
    docs = table(spark, sf_dir, "documents").select("doc_id", encoded(F.col("text"), model).alias("ids"))
    return docs.select("doc_id", "ids", decoded(F.col("ids"), model).alias("decoded")).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_simhash_golay")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_golay import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source IS NULL AS missing, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
sources AS (
  SELECT missing, source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY missing, source) - 1) % 3)::INT + 1]::DOUBLE AS weight
  FROM sizes GROUP BY missing, source),
filled AS (
  SELECT *, source_size * 2.0::DOUBLE AS bound,
         1.5::DOUBLE * sum(source_size) OVER () AS total,
         source_size * 2.0::DOUBLE / weight AS fill FROM sources),
leveled AS (
  SELECT *, (total - coalesce(sum(bound) OVER (ORDER BY fill, missing, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY fill, missing, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM filled),
targets AS (
  SELECT missing, source, source_size,
         coalesce(least(bound, weight * (SELECT first(level ORDER BY fill, missing, source) FROM leveled WHERE level <= fill)), bound) AS target
  FROM leveled),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS want,
         coalesce(sum(s.size) OVER (PARTITION BY s.missing, s.source ORDER BY s.key, s.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes s JOIN targets t USING (missing, source))
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE
         size * (want // source_size) + greatest(0, least(size, want % source_size - start)) END::BIGINT AS taken
FROM placed
"""


@query("op5_mix_sources", MIX_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("tie")


@query("op10_quality_gbt")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_gbt import classify, fit

    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)


@query("op4_order_minhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import edit_report

    return edit_report(table(spark, sf_dir, "documents"))


def _rules_sql() -> str:
    from .quality_rules import (
        COMMON_WORDS,
        LEAST_CHARS,
        LEAST_COMPARED_WORDS,
        LEAST_WORDS,
        MOST_CHAR_DISTANCE,
        MOST_REPEATED,
        MOST_WORD_DISTANCE,
        SLOTS,
    )

    common = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in COMMON_WORDS.items()) + " END"
    classes = "[" + ", ".join(
        [f"len(text) - len(regexp_replace(text, '{p}', '', 'g'))" for p in ("[a-z]", "[A-Z]", "[0-9]")]
        + ["len(text) - len(array_to_string(w, ''))", r"len(text) - len(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))"]
    ) + "]"
    slots = "[" + ", ".join(f"len(list_filter(w, lambda x: lower(x) = common[{k}]))" for k in range(1, SLOTS + 1)) + "]"

    def shares(counts: str, total: str, bins: int) -> list[str]:
        rest = f"({total} - " + " - ".join(f"{counts}[{k}]" for k in range(1, bins + 1)) + ")"
        return [f"(greatest({x}, 0)::DOUBLE / {total})" for x in [*(f"{counts}[{k}]" for k in range(1, bins + 1)), rest]]

    def distance(a: str, n: str, b: str, m: str, bins: int) -> str:
        halves = [
            f"(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + "
            f"CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END) / 2"
            for p, q in zip(shares(a, n, bins), shares(b, m, bins))
        ]
        return f"sqrt(greatest({' + '.join(halves)}, 0))"

    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{k}])" for k in range(1, n + 1)) + "]"
    return rf"""
WITH docs AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         {common} AS common FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS k, w FROM docs WHERE len(w) > 2),
repeated AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, w[k], w[k+1], w[k+2]) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS place FROM repeated) GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, d.lang, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, len(text) AS chars, {classes} AS classes,
         CASE WHEN common IS NOT NULL THEN {slots} END AS common
  FROM docs d LEFT JOIN covered c USING (doc_id)),
reference AS (
  SELECT lang, {sums('classes', 5)} AS all_classes, sum(chars) AS all_chars, {sums('common', SLOTS)} AS all_common, sum(n_words) AS all_words
  FROM counted GROUP BY lang),
far AS (
  SELECT c.*,
    CASE WHEN chars >= {LEAST_CHARS} THEN {distance('classes', 'chars', 'all_classes', 'all_chars', 5)} END AS cd,
    CASE WHEN n_words >= {LEAST_COMPARED_WORDS} AND common IS NOT NULL
         THEN {distance('common', 'n_words', 'all_common', 'all_words', SLOTS)} END AS wd,
    n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed
  FROM counted c JOIN reference r ON c.lang IS NOT DISTINCT FROM r.lang)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(cd, 0) <= {MOST_CHAR_DISTANCE} AND coalesce(wd, 0) <= {MOST_WORD_DISTANCE} AS kept,
       round(cd, 6) AS char_distance, round(wd, 6) AS word_distance
FROM far
"""


@query("op9_quality_rules", _rules_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


@query("op6_pii_crf")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii_crf import KINDS, fit, personal_data

    docs = table(spark, sf_dir, "documents")
    found = personal_data(docs, fit(docs))
    return found.select(
        "doc_id",
        *[F.regexp_count("base", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        "spans",
    )


def _license_sql() -> str:
    from .license_scan import NOTICES

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in NOTICES.items())
    return rf"""
WITH templates(template, text) AS (VALUES {values}),
shingled AS (
  SELECT template, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS shingle
  FROM (SELECT template, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM templates)),
wanted AS (SELECT DISTINCT template, shingle FROM shingled),
sizes AS (SELECT template, count(*) AS template_shingles FROM wanted GROUP BY template),
found AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS shingle
  FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents)),
shared AS (
  SELECT doc_id, template, count(DISTINCT shingle) AS shared FROM found JOIN wanted USING (shingle) GROUP BY doc_id, template)
SELECT doc_id, template, shared, template_shingles, shared::DOUBLE / template_shingles AS containment
FROM shared JOIN sizes USING (template) WHERE shared::DOUBLE / template_shingles >= 0.8
"""


@query("op7_license_scan", _license_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import notice_templates, scan

    docs = table(spark, sf_dir, "documents")
    return scan(docs, notice_templates(docs))


@query("op3_token_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_shards import read_ranks, sharded

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return sharded(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, scratch_path(spark, "shards"), again=True)


NEGATIVES_SQL = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS q, row_number() OVER () AS r
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS id,
         list_inner_product(a.q, c.q)::BIGINT AS score
  FROM kept AS a JOIN kept AS c ON a.r <> c.r WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT a, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS k
  FROM scored WHERE same QUALIFY k <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY a, k ORDER BY score DESC, id)::INTEGER AS rank,
         id AS negative_id, positive_score, score AS negative_score
  FROM positives AS p JOIN scored AS s USING (a)
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM ranked WHERE rank <= 3
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved))


TRIE_SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
         length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS content, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list(md5(content) ORDER BY place) AS marks, list(chars ORDER BY place) AS chars FROM turns GROUP BY conv_id),
borrowed AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % 6 AS h FROM lists),
rebuilt AS (
  SELECT b.conv_id, list_concat(coalesce(t.marks[1:b.h], []), b.marks[b.h + 1:]) AS marks,
         list_concat(coalesce(t.chars[1:b.h], []), b.chars[b.h + 1:]) AS chars
  FROM borrowed AS b LEFT JOIN lists AS t ON t.conv_id = b.conv_id - b.conv_id % 100),
members AS (
  SELECT conv_id, depth, array_to_string(marks[1:depth], '') AS node, CASE WHEN depth > 0 THEN array_to_string(marks[1:depth - 1], '') END AS parent,
         CASE WHEN depth > 0 THEN chars[depth] ELSE 0 END AS chars, depth = len(marks) AS ends
  FROM (SELECT *, unnest(range(0, len(marks) + 1)) AS depth FROM rebuilt)),
nodes AS (
  SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, min(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * min(chars) AS spare,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY node),
counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(k.n, 0) AS n_children FROM nodes AS n
  LEFT JOIN nodes AS p ON p.node = n.parent LEFT JOIN (SELECT parent AS node, count(*) AS n FROM nodes GROUP BY parent) AS k ON k.node = n.node),
sums AS (
  SELECT a.node, sum((c.n_children = 0)::INTEGER) AS n_leaves, sum(c.spare) AS saved_tokens
  FROM counted AS c JOIN members AS a ON a.conv_id = c.conv_id AND a.depth <= c.depth GROUP BY a.node)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM counted JOIN sums USING (node)
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import memberships, ordered_turns, prefix_trie, rebuilt

    turns = ordered_turns(table(spark, sf_dir, "conversations"))
    c = F.col("conv_id")
    return prefix_trie(memberships(*rebuilt(turns, c - c % 100, F.crc32(c.cast("string")) % 6, most=5)))


@query("op13_log_bilinear")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .log_bilinear import language_scores

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    return language_scores(docs, held_out)
