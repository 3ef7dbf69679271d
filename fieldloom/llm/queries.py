"""The registered queries of the corpus operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, line_dedup, main_text, packing, quality_mil, quality_rules, sharding, simhash, toxicity
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.kept_text"), 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents")).drop("linked")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_mil.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("row.doc_id", "held_out", "score", "predicted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_ids=False)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("row.doc_id", "held_out", "score", "predicted")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_sharding, op3_html_extraction, op4_quality_classifier, op5_quality_rules, op6_bpe, op7_packing, op8_embedding_dedup, op9_toxicity, op10_simhash)}

ORACLES = {
    "op8_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), n AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach(id, node) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.id, pairs.b FROM reach JOIN pairs ON reach.node = pairs.a
), comp AS (
  SELECT id, min(node) AS component_id FROM reach GROUP BY id
), links AS (
  SELECT a, count(*) AS n FROM pairs GROUP BY a
)
SELECT vec_id, coalesce(links.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON comp.id = vec_id LEFT JOIN links ON links.a = vec_id
""",
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), kept AS (
  SELECT keyed.doc_id, keyed.line, keyed.pos, (common.k IS NOT NULL AND keyed.doc_id <> keeper) AS dropped
  FROM keyed LEFT JOIN common ON keyed.k = common.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM kept GROUP BY doc_id
""",
    "op3_html_extraction": r"""
WITH inside AS (
  SELECT page_id, url, regexp_split_to_array(replace(coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '<br>', ' '), '</?(?:p|h1)>') AS parts FROM pages
), plain AS (
  SELECT page_id, url, list_transform(list_transform(parts, lambda x: regexp_replace(x, '<[^>]+>', '', 'g')),
    lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks FROM inside
), texts AS (
  SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM plain
)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
""",
    "op5_quality_rules": r"""
WITH parsed AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM parsed WHERE len(w) > 2)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r
), c AS (
  SELECT p.r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, len(lines) AS n_lines
  FROM parsed p LEFT JOIN covered ON covered.r = p.r
), d AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, (n_words >= 50)::INT + (n_words >= 200)::INT + (n_words >= 800)::INT AS s FROM c
), ratios AS (
  SELECT r, doc_id, s, base_failed, unnest([1, 2, 3, 4, 5]) AS rule, unnest([
    CASE WHEN word_chars > 0 THEN least(n_symbols::DOUBLE / word_chars, 1) ELSE 0 END, CASE WHEN word_chars > 0 THEN least(n_upper::DOUBLE / word_chars, 1) ELSE 0 END,
    CASE WHEN n_words > 0 THEN least(n_repeat_words::DOUBLE / n_words, 1) ELSE 0 END, CASE WHEN n_lines > 0 THEN least(n_dup_lines::DOUBLE / n_lines, 1) ELSE 0 END,
    CASE WHEN n_words > 0 THEN least(n_symbols::DOUBLE / n_words, 1) ELSE 0 END]::DOUBLE[]) AS ratio FROM d
), good AS (
  SELECT s, rule, ratio FROM ratios WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
), cuts AS (
  SELECT s, rule, cut, count(*) AS n, count(*) FILTER (ceil(ratio * 64) > cut) AS k FROM good CROSS JOIN (SELECT unnest(range(64)) AS cut) GROUP BY ALL
), bounds AS (
  -- the chance of k or fewer rejections if four in a thousand were rejected, at most the level over strata and rules
  SELECT s, rule, min(cut) AS cut FROM cuts
  WHERE k < n AND list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.004::DOUBLE) + (n - i) * ln(0.996::DOUBLE)))) <= 0.05::DOUBLE / 20 GROUP BY s, rule
), rejected AS (
  SELECT DISTINCT r FROM ratios JOIN bounds ON bounds.s = ratios.s AND bounds.rule = ratios.rule WHERE ratio > cut / 64.0::DOUBLE
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM rejected) AS kept FROM d
""",
}
