"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import exact_dedup, html, jaccard, lm, mixing, pieces, quality, sharding, toxicity, url_filter
from kindred.llm.shared import table


def op1_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.grades(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "severity", "grade", "toxic")


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "clean_text")


def op3_boosted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.content_sort(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="max")
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.perplexity(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_and_checked(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return rows.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), (5, 2, 1), 1.5, 2)
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ordinal_toxicity": op1_ordinal_toxicity,
        "op2_line_rules": op2_line_rules,
        "op3_boosted_nodes": op3_boosted_nodes,
        "op4_content_sort": op4_content_sort,
        "op5_kneser_ney": op5_kneser_ney,
        "op6_bloom_cascade": op6_bloom_cascade,
        "op7_shingle_join": op7_shingle_join,
        "op8_piece_lattice": op8_piece_lattice,
        "op9_histogram_sort": op9_histogram_sort,
        "op10_hash_threshold_mix": op10_hash_threshold_mix,
    }


SQL = {
    "op4_content_sort": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op6_bloom_cascade": r"""
WITH rules(rule, verdict, host_part, path_part) AS (
  VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
         ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
rests AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
fits AS (SELECT DISTINCT p.url, r.rule, r.verdict FROM (SELECT DISTINCT url, host, path FROM parts) p JOIN rules r
         ON (p.host = r.host_part OR ends_with(p.host, '.' || r.host_part)) AND starts_with(p.path, r.path_part)),
best AS (SELECT url, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY url)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.url IS NOT DISTINCT FROM b.url""",
    "op7_shingle_join": r"""
WITH RECURSIVE tokens AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM tokens),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, p.b FROM reach r JOIN links p ON p.a = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON s.doc_id = r.doc_id""",
    "op9_histogram_sort": r"""
WITH table_of AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, d: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t256),
raw AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k FROM documents),
sized AS (SELECT doc_id, k, CAST(octet_length(raw) + 1 AS BIGINT) AS size, list_transform(regexp_extract_all(hex(raw), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS l FROM raw),
bytes AS (SELECT doc_id, k, size, xor(list_reduce(list_prepend(4294967295, l), lambda c, x: xor(c >> 8, t256[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM sized, table_of),
placed AS (SELECT *, sum(size) OVER (ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(size) OVER (PARTITION BY k) AS below, sum(size) OVER () AS total FROM bytes),
dealt AS (SELECT *, CAST(below * 16 // total AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, shard, 'bytes' AS law, CAST(row_number() OVER (PARTITION BY shard ORDER BY k, doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt""",
    "op10_hash_threshold_mix": r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                      CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sums),
weighed AS (SELECT *, CAST([5, 2, 1][((r - 1) % 3 + 1)] AS DOUBLE) AS weight FROM ranked),
caps AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM weighed),
levels AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sums)
                      - coalesce(sum(cap) OVER (ORDER BY ratio, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (ORDER BY ratio, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
targets AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM levels WHERE level <= ratio) * weight) AS target FROM levels),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM targets),
places AS (SELECT source, h, sum(size) AS words FROM sized GROUP BY source, h),
ends AS (SELECT p.source, h, sum(words) OVER (PARTITION BY p.source ORDER BY h) AS e, words, target - times * source_size AS rest
         FROM places p JOIN plan t ON p.source IS NOT DISTINCT FROM t.source),
more AS (SELECT source, h, e <= rest OR (e - words <= rest AND e - rest <= rest - (e - words)) AS again FROM ends)
SELECT s.doc_id, s.size, t.source_size, t.target, CAST(s.size * (t.times + CASE WHEN m.again THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN plan t ON s.source IS NOT DISTINCT FROM t.source JOIN more m ON s.source IS NOT DISTINCT FROM m.source AND s.h = m.h""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
