"""The dealt operators' queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import aligned
from .common import table
from .decontaminate import contaminated
from .jaccard import join_components
from .licenses import scan_licenses
from .packing import pack
from .passages import remove_repeats
from .ppm import score_stream
from .quality import judged
from .revisits import crawl, header_text, resolve
from .spelling import spelling_forms
from .token_counts import token_counts
from .toxicity import score_toxicity
from .url_rules import judge

#: Host, path and verdict of the URL rules.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(crawl(table(spark, sf_dir, "pages"))).withColumn("headers", header_text(F.col("headers")))


def op2_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_stream(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


SQL_OP1 = r"""
WITH page AS (
  SELECT page_id AS p, md5(html) AS digest, length(html) AS length,
    regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages
), named AS (
  SELECT p, digest, length, '"' || substr(digest, 1, 12) || '"' AS tag, 'day ' || CAST(p % 1000 AS VARCHAR) AS stamp,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    regexp_replace(regexp_replace('&' || regexp_extract(bare, '\?(.*)$', 1), '&(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', '') AS query FROM page
), page2 AS (
  SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS u FROM named
), full_ AS (
  SELECT 3 * p AS record_id, u, p * 61 AS ts, digest, length, tag, stamp FROM page2 WHERE u IS NOT NULL
), asks AS (
  SELECT 3 * p + k AS record_id, u, p * 61 + days * 86400 + 17 AS ts,
    CASE WHEN p % 7 = k THEN NULL WHEN p % 5 = k THEN '"changed"' ELSE 'W/' || tag END AS tag, CASE WHEN p % 3 <> k THEN stamp END AS stamp
  FROM page2 CROSS JOIN (VALUES (1, 1), (2, 9)) d(k, days)
), ranked AS (
  SELECT a.record_id, a.u, a.ts, a.tag, a.stamp, f.record_id AS refers_to, f.ts AS f_ts, f.digest, f.length, f.tag AS f_tag, f.stamp AS f_stamp,
    row_number() OVER (PARTITION BY a.record_id ORDER BY f.ts DESC, f.record_id DESC) AS r
  FROM asks a LEFT JOIN full_ f ON f.u = a.u AND f.ts < a.ts
), judged AS (
  SELECT *, CASE WHEN refers_to IS NULL THEN 'no response' WHEN tag IS NOT NULL AND f_tag IS NOT NULL THEN CASE WHEN regexp_replace(tag, '^W/', '') = f_tag THEN 'resolved' ELSE 'modified' END
    WHEN stamp IS NOT NULL AND f_stamp IS NOT NULL THEN CASE WHEN stamp = f_stamp THEN 'resolved' ELSE 'modified' END ELSE 'no validator' END AS outcome
  FROM ranked WHERE r = 1
)
SELECT record_id, u AS canonical_url, ts, outcome, refers_to, ts - f_ts AS age, CASE WHEN outcome = 'resolved' THEN digest END AS digest, CASE WHEN outcome = 'resolved' THEN length END AS length,
  CASE WHEN outcome = 'resolved' THEN 'content-type=text/html' || chr(10) || 'date=' || CAST(ts AS VARCHAR) || chr(10) || 'etag=' || coalesce(tag, f_tag) || chr(10) || 'last-modified=' || coalesce(stamp, f_stamp) END AS headers
FROM judged
"""

SQL_OP10 = """
WITH cut AS (
  SELECT page_id, url, strpos(url, '://') AS p FROM pages
), rest AS (
  SELECT page_id, CASE WHEN p > 0 THEN substr(url, p + 3) END AS rest FROM cut
), named AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(substr(regexp_extract(rest, '^([^?#]*)', 1), length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '') AS path FROM rest
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM named
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

QUERIES = {
    "op1_revisits": op1_revisits,
    "op2_phrase_automata": op2_phrase_automata,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_ppm": op5_ppm,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_license_scan": op9_license_scan,
    "op10_url_rules": op10_url_rules,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_toxicity": op12_toxicity,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
ORACLE_SQL = {"op1_revisits": SQL_OP1, "op10_url_rules": SQL_OP10}
