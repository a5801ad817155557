"""The operators bound to the tables of a data folder, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, fingerprint, line_dedup, lm_score, packing, quality, simhash, token_counts, token_files, url_filter
from .common import shared_path

#: The vocabulary files of the queries; ids of the ends; the tokens of a sequence.
WORD_BPE, BYTE_BPE, PIECES = "word_bpe_49k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
PACK_END, FILE_END, MAX_TOKENS = 1, 2, 4096
#: Verdict, host and path of the rules on urls.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(_documents(spark, sf_dir), min_chars=40, min_docs=5)
    return kept.select("doc_id", F.col("ox_n_lines").alias("n_lines"), F.col("ox_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), hot AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), f AS (
  SELECT k.*, hot.key IS NOT NULL AND k.doc_id <> hot.keeper AS gone FROM k LEFT JOIN hot ON k.key = hot.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = quality.judged(_documents(spark, sf_dir))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return a.select("doc_id", *[F.col(f"ox_{n}").alias(n) for n in names])


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS worded
  FROM documents
), win AS (
  SELECT doc_id, i, list_slice(words, i, i + 4) AS g
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w)
), rep AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c >= 2
), cov AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id
), l AS (
  SELECT doc_id, unnest(worded) AS line FROM w
), lw AS (
  SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM l
), lf AS (
  SELECT doc_id, line,
         len(regexp_extract_all(line, '[#*$%&<>]')) >= 0.5 * len(words)
         OR len(regexp_extract_all(line, '!')) >= 0.5 * len(words)
         OR (len(words) >= 30 AND NOT regexp_matches(line, '[.,;:!?]'))
         OR len(regexp_extract_all(line, '[|»›]')) >= greatest(2.0, 0.2 * len(words))
         OR (len(words) >= 12 AND len(list_distinct(words)) < 0.25 * len(words))
         OR (length(line) <= 200 AND regexp_matches(lower(line), 'PHRASES')) AS fails
  FROM lw
), good AS (
  SELECT doc_id, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM lf WHERE NOT fails GROUP BY doc_id
), b AS (
  SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(worded) - len(list_distinct(worded)) AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(good.chars, 0) AS chars
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id LEFT JOIN good ON w.doc_id = good.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND chars >= 0.5 * word_chars AS kept
FROM b
""".replace("PHRASES", "|".join(quality.BOILERPLATE).replace("'", "''"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(_documents(spark, sf_dir))


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), MAX_TOKENS, PACK_END)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir), shingle=3, k=3)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN
    tokens = byte_bpe.decode(byte_bpe.encode(_documents(spark, sf_dir), path, pattern), path, pattern)
    return tokens.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_documents(spark, sf_dir), public_tokenizers.path(PIECES))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path(PIECES))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    token_files.write_tokens(_documents(spark, sf_dir), path, public_tokenizers.path(WORD_BPE), FILE_END)
    return token_files.checksums(token_files.read_tokens(spark, path))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_pattern_packing": op2_pattern_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_lm_score": op6_lm_score,
    "op7_token_counts": op7_token_counts,
    "op8_fingerprints": op8_fingerprints,
    "op9_url_filter": op9_url_filter,
    "op10_token_files": op10_token_files,
}
ORACLES: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op3_quality_rules": OP3_SQL}
