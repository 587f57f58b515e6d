"""Queries of the training-data operators, for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, mixing, near_dup, neighbours, quality, repeats, token_counts, url_filters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.suffix_array_dedup(docs, width=200).select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


#: Bytes as pairs of hexadecimal digits; a byte is removed if a window that starts at most 199 bytes before it occurs twice.
OP2_SQL = """
WITH texts AS (SELECT doc_id, row_number() OVER () AS r, upper(hex(encode(coalesce(text, '')))) AS h FROM documents),
windows AS (SELECT r, i, substr(h, 2 * i + 1, 400) AS w FROM (SELECT r, h, unnest(range(0, strlen(h) // 2 - 199)) AS i FROM texts WHERE strlen(h) >= 400)),
often AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
starts AS (SELECT r, i FROM windows SEMI JOIN often USING (w)),
ends AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM starts),
spans AS (SELECT r, min(i) AS a, max(i) + 200 AS z FROM (SELECT r, i, count(*) FILTER (before IS NULL OR i > before + 200) OVER (PARTITION BY r ORDER BY i) AS n FROM ends) GROUP BY r, n),
gaps AS (
  SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS from_, lead(a) OVER (PARTITION BY r ORDER BY a) IS NULL AS last FROM spans),
cut AS (
  SELECT texts.r, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)) || CASE WHEN last THEN substr(h, 2 * z + 1) ELSE '' END, '' ORDER BY a) AS kept, sum(z - a) AS n_removed, count(*) AS n_spans
  FROM texts JOIN gaps ON gaps.r = texts.r GROUP BY 1)
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM texts LEFT JOIN cut ON cut.r = texts.r
"""


def op3_lempel_ziv_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.lempel_ziv_dedup(docs, width=35).select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


OP3_SQL = r"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM texts WHERE len(w) >= 35)),
often AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
starts AS (SELECT r, i FROM windows SEMI JOIN often USING (g)),
words AS (SELECT r, doc_id, i, w[i] AS word FROM (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts)),
near AS (SELECT words.r, words.i, word, max(s.i) OVER (PARTITION BY words.r ORDER BY words.i) AS latest FROM words LEFT JOIN starts s ON s.r = words.r AND s.i = words.i),
counts AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (latest >= i - 34) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (latest IS NULL OR latest < i - 34) AS kept FROM near GROUP BY r)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN counts ON counts.r = texts.r
"""


def op4_digest_cache_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


def op5_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM phrases))),
hits AS (SELECT doc_id, item_id, i, n FROM places JOIN phrases USING (n, p)),
hit_words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY 1),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def op6_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).select("doc_id", *licenses.RESULT)


def op8_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=20)


#: The rules that the contract of op9 names.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op9_url_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.filter_urls(pages, url_filters.rules_table(spark, URL_RULES))


#: Its rules stand as they were given: net/de/ is still block here, where the contract and URL_RULES say allow.
OP9_SQL = """
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
rest AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM rest),
urls AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM hosts),
best AS (
  SELECT page_id, host, path,
         (SELECT max_by(struct_pack(r := rule_host || rule_path, v := rule_verdict), length(rule_host) * 1000 + length(rule_path))
          FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS b
  FROM urls)
SELECT page_id, host, path, b.r AS rule, coalesce(b.v, 'allow') AS verdict FROM best
"""


def op10_b_bit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_duplicates(docs, size=3, percent=85)


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
flat AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared.n >= 85 * (p.n + q.n - shared.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, component_id) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT b, component_id FROM reach JOIN both_ways ON a = doc_id),
least_id AS (SELECT doc_id, min(component_id) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least_id USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bradley_terry_quality": op1_bradley_terry_quality,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_lempel_ziv_dedup": op3_lempel_ziv_dedup,
    "op4_digest_cache_tokens": op4_digest_cache_tokens,
    "op5_fm_index_decontamination": op5_fm_index_decontamination,
    "op6_cube_mixing": op6_cube_mixing,
    "op7_license_index": op7_license_index,
    "op8_projection_forest": op8_projection_forest,
    "op9_url_range_join": op9_url_range_join,
    "op10_b_bit_minhash": op10_b_bit_minhash,
}

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_array_dedup": OP2_SQL,
    "op3_lempel_ziv_dedup": OP3_SQL,
    "op5_fm_index_decontamination": OP5_SQL,
    "op9_url_range_join": OP9_SQL,
    "op10_b_bit_minhash": OP10_SQL,
}
