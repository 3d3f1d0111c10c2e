"""Queries over the whole given tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oppflow.llm import bpe, chat_format, exact_dedup, filter_audit, langid, lexical, media, mixing, quality, secret_scan, simhash, substring, token_files
from oppflow.shared import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), bpe.public_path("byte_bpe_50k.json"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digest(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(table(spark, sf_dir, "documents"), bpe.public_path("word_bpe_49k.json"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_bpe, op3_exact_dedup, op4_quality, op5_langid, op6_token_files, op7_substring, op8_simhash, op9_secret_scan, op10_media, op11_lexical_search, op12_chat_format, op13_filter_audit)}

ORACLE_SQL = {
    "op3_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(t) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
""",
    "op7_substring": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)
), dup AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM dup)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w) ANTI JOIN gone USING (doc_id, p)
  GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
""",
    "op11_lexical_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), own AS (
  SELECT row_number() OVER () AS r, doc_id, ts, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0
), total AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM own
), item AS (
  SELECT item_row, item_id, t, count(*)::BIGINT AS times FROM (
    SELECT row_number() OVER () AS item_row, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
  ) GROUP BY ALL
), tf AS (
  SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM own) WHERE t IN (SELECT t FROM item) GROUP BY r, t
), weight AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY t, n_docs
), part AS (
  SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms)))) AS c FROM tf JOIN own USING (r) JOIN weight USING (t), total
), scored AS (
  SELECT item_row, item_id, r, doc_id, sum(times * c)::BIGINT AS score FROM item JOIN part USING (t) JOIN own USING (r) GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id, r))::INT AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
""",
    "op12_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS seq,
         len(regexp_extract_all(role || chr(0) || text, '\\|<\||</?s>|\[/?INST\]')) + length(role) + length(text) + length('<|role|><|text|><|end|>') AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
""",
    "op13_filter_audit": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d
), lab AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), min(doc_id) OVER (PARTITION BY t) IS NOT NULL), false)::INT AS mask
  FROM w LEFT JOIN lab USING (doc_id)
), g AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, unnest([a.bit, b.bit, c.bit, d.bit, e.bit]) AS bit, unnest([1, 2, 3, 4, 5]) AS step,
         unnest([0, a.bit, a.bit + b.bit, a.bit + b.bit + c.bit, a.bit + b.bit + c.bit + d.bit]) AS before
  FROM l a JOIN l b ON b.f <> a.f JOIN l c ON c.f NOT IN (a.f, b.f) JOIN l d ON d.f NOT IN (a.f, b.f, c.f) JOIN l e ON e.f NOT IN (a.f, b.f, c.f, d.f)
), s AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM g, o GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM s
""",
}
