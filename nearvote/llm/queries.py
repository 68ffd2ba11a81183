"""The registered queries opN_* and, where SQL can express them, their DuckDB twins.

A query applies its operator, with production parameters, to a whole table and
derives the contract's columns from the operator's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocknames, bytepair, langid, linedup, nra, packing, preference, simhash, tokenstore, warc
from .common import scratch_path
from .resources import pattern, vocabulary


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.crawl_log(_read(spark, sf_dir, "pages")))
    return found.withColumn("headers", warc.header_lines(F.col("headers")))


OP1_SQL = """
WITH base AS (
  SELECT page_id AS n, url, sha256(coalesce(html, '')) AS sha, strlen(coalesce(html, '')) AS size FROM pages),
records AS (
  SELECT n, 2 * n AS record_id, true AS is_response, url, n * 60 AS ts FROM base
  UNION ALL
  SELECT n, 2 * n + 1, false,
         CASE WHEN n % 3 = 0 THEN url || '#seen'
              WHEN n % 3 = 1 THEN regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_campaign=x'
              ELSE 'HTTPS://WWW.' || regexp_replace(url, '^[a-z]+://', '') END,
         CASE WHEN n % 13 = 0 THEN n * 60 - 1 ELSE n * 60 + 90 END FROM base),
bare AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM records),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^www[0-9]*[.]', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(b, '^[^?]*[?](.*)$', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|gclid|fbclid|ref|phpsessid|jsessionid|sessionid)(=|$)'))) AS q
  FROM bare),
keyed AS (SELECT n, record_id, is_response, ts, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS curl FROM parts),
matched AS (
  SELECT v.n, v.record_id, v.curl, v.ts, r.n AS rn, r.record_id AS response_id
  FROM keyed v LEFT JOIN keyed r ON r.is_response AND r.curl = v.curl AND r.ts < v.ts
  WHERE NOT v.is_response
  QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC NULLS LAST, r.record_id DESC) = 1),
full_rows AS (
  SELECT m.*, o.sha AS osha, o.size AS osize, x.sha AS xsha,
         CASE WHEN m.n % 7 = 0 THEN NULL WHEN m.n % 5 = 0 THEN '"changed"' ELSE '"' || substr(x.sha, 1, 16) || '"' END AS tag,
         '"' || substr(o.sha, 1, 16) || '"' AS otag,
         CASE WHEN m.n % 14 = 0 THEN '0' WHEN m.n % 7 = 0 THEN CAST(m.n * 60 - m.n % 7 AS VARCHAR) END AS modified,
         CAST(o.n * 60 - o.n % 7 AS VARCHAR) AS omodified,
         CASE WHEN m.n % 11 = 0 THEN x.sha END AS digest
  FROM matched m JOIN base x ON x.n = m.n LEFT JOIN base o ON o.n = m.rn),
judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no_response'
    WHEN coalesce(tag = otag, modified = omodified) = false OR (digest = osha) = false THEN 'mismatch'
    WHEN coalesce(tag = otag, modified = omodified) IS NULL AND (digest = osha) IS NULL THEN 'unchecked'
    ELSE 'resolved' END AS outcome FROM full_rows)
SELECT record_id, curl AS canonical_url, ts, outcome, response_id,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN 'sha256:' || osha END AS digest,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN array_to_string(list_sort([
    'cache-control: max-age=120', 'content-length: ' || osize, 'content-type: text/html; charset=utf-8', 'date: ' || (n * 60 + 90),
    'etag: ' || CASE WHEN n % 7 = 0 THEN otag ELSE CASE WHEN n % 5 = 0 THEN tag ELSE 'W/' || tag END END,
    'last-modified: ' || coalesce(modified, omodified)]), chr(10)) END AS headers
FROM judged
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.matching_lines(_read(spark, sf_dir, "documents"), threshold=0.8)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    manifest = tokenstore.write(_read(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"), end_id=2)
    return tokenstore.read(spark, folder, manifest)


def op4_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.preference_pairs(*preference.last_reply_pairs(_read(spark, sf_dir, "conversations")))
    sides = [f(F.col(side)).alias(name) for side in ("chosen", "rejected") for f, name in ((preference.joined, side), (preference.mask, f"{side}_mask"))]
    return pairs.select("pair_id", "n_prompt_turns", "prompt", *sides)


OP4_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
last AS (
  SELECT conv_id, turn AS last_turn, text AS reply FROM t WHERE role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC NULLS LAST) = 1),
kept AS (
  SELECT t.conv_id, t.turn, t.role, t.text,
         CASE WHEN t.turn = l.last_turn AND t.role = 'assistant' THEN coalesce(o.reply, '') ELSE t.text END AS other
  FROM t JOIN last l ON t.conv_id = l.conv_id AND t.turn <= l.last_turn LEFT JOIN last o ON o.conv_id = xor(t.conv_id, 1)),
chosen AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS i, role, text FROM kept),
rejected AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, other NULLS FIRST) AS i, role, other AS text
  FROM (SELECT DISTINCT conv_id, turn, role, other FROM kept)),
compared AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.i, r.i) AS i,
         c.i IS NOT NULL AND r.i IS NOT NULL AND c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS same
  FROM chosen c FULL JOIN rejected r ON c.conv_id = r.conv_id AND c.i = r.i),
prefix AS (SELECT conv_id, coalesce(min(i) FILTER (NOT same) - 1, max(i)) AS n FROM compared GROUP BY conv_id),
sides AS (SELECT 'c' AS side, * FROM chosen UNION ALL SELECT 'r', * FROM rejected),
parts AS (
  SELECT s.conv_id, s.side, s.i, p.n, '<|im_start|>' || coalesce(role, '') || chr(10) AS head, coalesce(text, '') || '<|im_end|>' AS body, role = 'assistant' AS trained
  FROM sides s JOIN prefix p ON p.conv_id = s.conv_id)
SELECT conv_id AS pair_id, CAST(any_value(n) AS INTEGER) AS n_prompt_turns,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (side = 'c' AND i <= n), '') AS prompt,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (side = 'c' AND i > n), '') AS chosen,
  coalesce(string_agg(length(head) || '- ' || length(body) || CASE WHEN trained THEN '+' ELSE '-' END || ' 1-', ' ' ORDER BY i) FILTER (side = 'c' AND i > n), '') AS chosen_mask,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (side = 'r' AND i > n), '') AS rejected,
  coalesce(string_agg(length(head) || '- ' || length(body) || CASE WHEN trained THEN '+' ELSE '-' END || ' 1-', ' ' ORDER BY i) FILTER (side = 'r' AND i > n), '') AS rejected_mask
FROM parts GROUP BY conv_id
"""


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepair.encode(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pattern())


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), pattern(), end_id=1)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocknames.exact_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op9_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra.top_k(_read(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.is_held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score
FROM pairs WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 20
"""


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"), tau=4, m=5)
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_revisits, op2_line_dedup, op3_token_store, op4_preference_pairs, op5_byte_bpe, op6_packing,
        op7_exact_dedup, op8_language_id, op9_top_k_search, op10_simhash_near_dedup,
    )
}
ORACLES: dict[str, str] = {
    "op1_warc_revisits": OP1_SQL,
    "op4_preference_pairs": OP4_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op9_top_k_search": OP9_SQL,
}
