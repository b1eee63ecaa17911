"""The thin queries ``opN_<name>`` over whole tables, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, decontam, fill_middle, host_quality, jaccard, licenses, secrets, simhash, sst, target_encoding, token_counts, toxicity, url_filters
from foliant.llm.common import table
from foliant.llm.shop_sql import OP11_SQL, OP13_SQL
from foliant.session import fresh_path

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
REJECT_AT = 0.7


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), token_counts.run_cache(spark)
    )
    return counts.withColumn("over_limit", counts["n_tokens"] > 4096)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.select("doc_id", "text"), labels.where(~toxicity.held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= REJECT_AT).cast("int").alias("predicted")
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.document_licences(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), ids=False)


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_quality.judge_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_sst_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-shards")
    sst.write_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return sst.read_documents(spark, folder)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_windows(docs, table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("hit_items", ","), 256)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        listed.alias("items_sha256"),
        decontam.contaminated().alias("contaminated")
    )


def op11_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_encoding.encode_lines(*(table(spark, sf_dir, name) for name in ("sale_lines", "sales", "items", "vendors", "clients")))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(text, 256).alias("restored_sha256")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_url_filters,
        op2_token_counts,
        op3_secrets,
        op4_toxicity,
        op5_licenses,
        op6_bpe,
        op7_host_quality,
        op8_sst_shards,
        op9_jaccard,
        op10_decontamination,
        op11_target_encoding,
        op12_simhash,
        op13_fill_middle
    )
    return {f.__name__: f for f in found}


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP10_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
wins AS MATERIALIZED (
  SELECT item, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
dw AS MATERIALIZED (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS MATERIALIZED (SELECT doc_id, dw.n, s, item FROM dw JOIN wins USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

OP7_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    len(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM documents),
wins AS (
  SELECT doc_id, s, array_to_string(w[s:s + 4], ' ') AS win
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS s FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, s FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(s, s + 4)) AS p FROM twice) GROUP BY doc_id),
m AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars, n_symbols,
    len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)),
f AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
sums AS MATERIALIZED (
  SELECT source, count(*) AS n, [count(*) FILTER (base_failed), count(*) FILTER (100 * n_symbols > 10 * n_words), count(*) FILTER (100 * n_dup_lines > 30 * n_lines)] AS fails
  FROM f GROUP BY source),
hosts AS MATERIALIZED (SELECT source, n, rule, fails[rule] AS failed FROM sums, (SELECT unnest([1, 2, 3]) AS rule)),
p AS (SELECT rule, avg(failed / n) AS mean, var_samp(failed / n) AS v, avg(1 / n) AS inv FROM hosts GROUP BY rule),
q AS (SELECT rule, mean, CASE WHEN v IS NULL THEN NULL WHEN mean * (1 - mean) <= 0 OR v - mean * (1 - mean) * inv <= 0 THEN 1000.0
  ELSE least(greatest(mean * (1 - mean) / ((v - mean * (1 - mean) * inv) / greatest(1 - inv, 1e-9)) - 1, 1e-3), 1000.0) END AS strength FROM p),
ab AS (SELECT rule, CASE WHEN strength IS NULL THEN 1.0 ELSE greatest(mean * strength, 1e-6) END AS a, CASE WHEN strength IS NULL THEN 1.0 ELSE greatest((1 - mean) * strength, 1e-6) END AS b FROM q),
verdicts AS (SELECT source, bool_and((failed + a) / (n + a + b) <= 0.5) AS ok FROM hosts JOIN ab USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM f JOIN verdicts v ON f.source IS NOT DISTINCT FROM v.source
"""

OP1_SQL = r"""
WITH RECURSIVE p AS MATERIALIZED (
  SELECT page_id, url, html, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(rh, rp, said)),
tags AS (
  SELECT url AS a, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM p),
named AS (
  SELECT a, CASE WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, '(?i)\srel\s*=\s*["'']?canonical') THEN regexp_extract(tag, '(?i)\shref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?i)url\s*=\s*["'']?([^"''>]+)', 1) END AS b FROM tags),
edges AS MATERIALIZED (SELECT DISTINCT regexp_replace(a, '#.*', '') AS a, regexp_replace(b, '#.*', '') AS b FROM named WHERE b LIKE '%://%'),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
seen AS (
  SELECT r.a, s.said FROM reach r CROSS JOIN LATERAL (
    SELECT arg_max(said, len(rh || rp)) AS said FROM rules
    WHERE (lower(regexp_extract(r.b, '://([^/?#]*)', 1)) = rh OR ends_with(lower(regexp_extract(r.b, '://([^/?#]*)', 1)), '.' || rh)) AND starts_with(regexp_extract(r.b, '://[^/?#]*([^?#]*)', 1), rp)) s),
class AS (SELECT a, CASE WHEN bool_or(said = 'allow') THEN 'allow' WHEN bool_or(said = 'block') THEN 'block' END AS said FROM seen GROUP BY a),
own AS (
  SELECT DISTINCT host, path, arg_max(rh || rp, len(rh || rp)) AS rule, arg_max(said, len(rh || rp)) AS said
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, p.host, p.path, own.rule, coalesce(own.said, class.said, 'allow') AS verdict
FROM p LEFT JOIN own ON p.host = own.host AND p.path = own.path LEFT JOIN class ON class.a = regexp_replace(p.url, '#.*', '')
"""


#: Shingles of all pairs, and classes as what can be reached by links.
OP9_SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS s FROM d WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
tops AS (SELECT a, min(b) AS top FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT doc_id, coalesce(least(top, doc_id), doc_id) AS class_id, coalesce(n, 0) AS n_links
FROM d LEFT JOIN tops ON tops.a = doc_id LEFT JOIN counts ON counts.a = doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": OP1_SQL,
        "op9_jaccard": OP9_SQL,
        "op7_host_quality": OP7_SQL,
        "op10_decontamination": OP10_SQL,
        "op11_target_encoding": OP11_SQL,
        "op13_fill_middle": OP13_SQL
    }
