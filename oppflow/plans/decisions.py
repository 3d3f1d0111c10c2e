"""Queries over decisions on scored records and their DuckDB SQL: gates, judged and researched tiers, snapshots, listings.

``orders`` stand for scored records here: the key makes scores and shares, the
priority makes flags, the order date is the deadline.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from oppflow.functions import fixed, keys
from oppflow.operators import merge, report, rules, score
from oppflow.plans.queries import _KEYS, _RECORDS, AS_OF, ORACLE_SQL, _day, _list, query, records
from oppflow.shared import table

_PATTERN = "'(?i)" + "|".join(f"(?:{p})" for p in fixed.NEWS_PATTERNS) + "'"
_CALL = "'(?i)" + "|".join(f"(?:{p})" for p in fixed.CALL_SIGNALS) + "'"
_TIER = "CASE WHEN {s} >= 3.8 THEN 'APPLY_NOW' WHEN {s} >= 3.2 THEN 'CONSIDER' WHEN {s} >= 2.5 THEN 'MONITOR' ELSE 'SKIP' END"


def _no_flags():
    return F.array().cast("array<string>")


def _part(c: str, by: int, over: float):
    return F.col(c) % by / over


@query(
    f"""SELECT o_orderkey AS id, CASE WHEN o_orderpriority IN {_list(fixed.HARD_FLAGS)} THEN o_orderpriority WHEN o_orderstatus = 'P' THEN 'VC_ONLY'
 WHEN date_diff('day', DATE '{AS_OF}', o_orderdate::DATE) < 0 THEN 'EXPIRED' WHEN o_orderkey % 50 / 10 < 1.5 THEN 'LOW_SCORE' WHEN o_custkey % 7 = 0 THEN 'NEWS_ARTICLE' END AS reason FROM orders"""
)
def gate_reasons(spark, sf_dir):
    """the first reason to drop each scored record, or null."""
    flags = F.when(F.col("o_orderstatus") == "P", F.array(F.lit("NO_AMOUNT"), F.lit("VC_ONLY"))).otherwise(F.array("o_orderpriority"))
    days = F.date_diff(F.to_date("o_orderdate"), _day())
    reason = rules.reject_reason(flags, days, _part("o_orderkey", 50, 10), F.col("o_custkey") % 7 == 0)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), reason.alias("reason"))


@query(
    rf"""WITH r AS ({_RECORDS}), v AS (SELECT id, title || CASE id % 4 WHEN 0 THEN ' update 2024' WHEN 1 THEN ' Situation Report' ELSE '' END AS title,
 CASE WHEN id % 8 IN (0, 1) THEN 'Call for Proposals ' || description WHEN id % 4 = 2 THEN '' ELSE description END AS text, CASE WHEN id % 8 = 2 THEN url || '/report/1' ELSE url END AS url FROM r)
SELECT id, NOT regexp_matches(title || ' ' || text, {_CALL}) AND (regexp_matches(title, {_PATTERN}) OR (text = '' AND contains(url, '/report/'))) AS news FROM v"""
)
def news_pages(spark, sf_dir):
    """news among the pages, with signs of news and of calls put into some."""
    k = F.col("id")
    title = F.concat("title", F.when(k % 4 == 0, " update 2024").when(k % 4 == 1, " Situation Report").otherwise(""))
    text = F.when((k % 8).isin(0, 1), F.concat(F.lit("Call for Proposals "), "description")).when(k % 4 == 2, "").otherwise(F.col("description"))
    url = F.when(k % 8 == 2, F.concat("url", F.lit("/report/1"))).otherwise(F.col("url"))
    return records(spark, sf_dir).select("id", rules.is_news(title, text, url).alias("news"))


@query(
    f"""WITH a AS (SELECT o_orderkey AS id, least(round(round(o_orderkey % 90 / 100 + o_custkey % 70 / 100 + o_orderkey % 30 / 100 + 0.5 + 0.3, 2) + o_orderkey % 13 / 10 - 0.1 + 0.05, 2), 5.0) AS final_score FROM orders WHERE o_orderkey % 3 <> 0)
SELECT id, final_score, {_TIER.format(s="final_score")} AS recommendation FROM a"""
)
def rescored(spark, sf_dir):
    """Stored score lines with new judged parts; records without a judgement are left out."""
    none = F.lit(None).cast("double")
    parts = {"geo": _part("o_orderkey", 90, 100), "size": _part("o_custkey", 70, 100), "deadline": _part("o_orderkey", 30, 100), "org_type": F.lit(0.5), "partnership": F.lit(0.3), "mission_alignment": none, "competitive_fit": none, "strategic_fit": F.lit(0.05)}
    o = table(spark, sf_dir, "orders")
    lines = o.select(F.col("o_orderkey").alias("id"), score.score_breakdown(parts, F.lit(1.0)).alias("breakdown"))
    said = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), _part("o_orderkey", 13, 10).alias("mission_alignment"), F.lit(-0.1).alias("competitive_fit"))
    return score.rescore(lines, said).select("id", "final_score", "recommendation")


@query(
    f"""WITH a AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, least(round(o_orderkey % 40 / 10 + CASE WHEN o_orderkey % 5 IN (0, 1) THEN 0 ELSE o_custkey % 12 / 10 END, 2), 5.0) AS final_score FROM orders)
SELECT id, final_score, CASE WHEN k = 2 THEN 'INELIGIBLE' ELSE {_TIER.format(s="final_score")} END AS recommendation, k = 3 AS not_a_grant FROM a"""
)
def judged(spark, sf_dir):
    """Final scores and tiers from the judge's replies; some are broken, some are missing."""
    o = table(spark, sf_dir, "orders")
    df = o.select(F.col("o_orderkey").alias("id"), _part("o_orderkey", 40, 10).alias("prescore"), _no_flags().alias("flags"))
    k = F.col("o_orderkey") % 5
    reply = F.format_string('{"mission_alignment": %.1f, "_ineligible": %s, "_not_a_grant": %s}', _part("o_custkey", 12, 10), (k == 2).cast("string"), (k == 3).cast("string"))
    said = o.filter(k > 0).select(F.col("o_orderkey").alias("id"), F.when(k == 1, "no JSON").otherwise(reply).alias("reply"))
    return score.judge(df, said).select("id", "final_score", "recommendation", "not_a_grant")


@query(
    f"""{_KEYS}, f AS (SELECT id, id % 45 / 10 AS now, CASE WHEN own_host THEN domain || '||' || coalesce(year, '') ELSE '|' || array_to_string((acronyms[:2] || word_list[:5])[:5], '-') || '|' || coalesce(year, '') END AS fp FROM k),
keyed AS (SELECT id, now, CASE WHEN length(fp) > 3 THEN 'fp:' || fp ELSE 'id:' || id END AS rk FROM f),
s AS (SELECT rk, min(id) AS rid FROM keyed WHERE id % 3 = 0 GROUP BY rk)
SELECT r.id, rid IS NOT NULL AS researched, CASE WHEN rid IS NULL OR (rid >= 90 AND abs(now - rid % 40 / 10) >= 0.5) THEN 'MONITOR' ELSE 'CONSIDER' END AS tier FROM keyed r LEFT JOIN s ON s.rk = r.rk"""
)
def researched_tiers(spark, sf_dir):
    """The last research of the same key decides the tier, unless it is stale."""
    r = records(spark, sf_dir)
    df = r.select("id", "title", "url", _part("id", 45, 10).alias("final_score"), F.lit("MONITOR").alias("recommendation"))
    when = (F.unix_timestamp(_day().cast("timestamp")) - F.col("id") * 86400).cast("timestamp")
    done = r.filter("id % 3 = 0").select(keys.research_key(keys.fingerprint(F.col("title"), F.col("url")), F.col("id")).alias("research_key"), F.lit("CONSIDER").alias("recommendation"), when.alias("researched_at"), _part("id", 40, 10).alias("scored_at_score"))
    return merge.attach_research(df, done, _day()).select("id", "researched", "tier")


@query(
    """WITH b AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT * FROM b UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 10 <> 0 AND o_custkey NOT IN (SELECT o_custkey FROM b) GROUP BY o_custkey"""
)
def new_catalogue_rows(spark, sf_dir):
    """The catalogue and the first row of each key that it lacks; new rows without a key are dropped."""
    o = table(spark, sf_dir, "orders")
    new = o.filter("o_orderstatus = 'O'").select(F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("o_custkey"), "o_orderkey")
    return merge.merge_first_wins(o.filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey"), new, "o_custkey", [F.col("o_orderkey")])


@query(
    """WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 60 >= 40 THEN 'APPLY_NOW' WHEN o_orderkey % 60 >= 20 THEN 'CONSIDER' WHEN o_orderkey % 60 >= 10 THEN 'MONITOR' ELSE 'SKIP' END AS likely, o_orderstatus = 'F' AS closed, o_custkey % 3 = 0 AS reopens, o_orderpriority AS p FROM orders),
g AS (SELECT *, CASE WHEN likely = 'APPLY_NOW' AND closed AND NOT reopens THEN 'CONSIDER' ELSE likely END AS tier FROM t)
SELECT id, likely, tier, CASE tier WHEN 'APPLY_NOW' THEN 0 WHEN 'CONSIDER' THEN 1 WHEN 'MONITOR' THEN 2 ELSE 3 END::INTEGER AS place, CASE WHEN closed THEN 'Closed' WHEN p <> '5-LOW' THEN 'Open' ELSE 'Could not confirm' END AS status FROM g"""
)
def research_outcomes(spark, sf_dir):
    """Tiers from a likelihood, held back where a call is closed, their order, and the status line."""
    closed, evidence = F.col("o_orderstatus") == "F", F.nullif("o_orderpriority", F.lit("5-LOW"))
    likely = score.tier_from_likelihood(F.col("o_orderkey") % 60)
    tier = score.timing_gate(likely, closed, F.col("o_custkey") % 3 == 0)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), likely.alias("likely"), tier.alias("tier"), score.tier_order(tier).alias("place"), score.research_status(closed, evidence).alias("status"))


@query(
    """WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey * 7 ELSE 0 END AS lo, CASE WHEN o_orderkey % 5 > 1 THEN o_orderkey * 31 END AS hi FROM orders)
SELECT id, CASE WHEN lo > 0 AND hi > 0 THEN '$' || format('{:,}', lo) || ' – $' || format('{:,}', hi) WHEN hi > 0 THEN 'Up to $' || format('{:,}', hi) WHEN lo > 0 THEN 'From $' || format('{:,}', lo) ELSE 'Amount unknown' END AS amount FROM a"""
)
def amount_lines(spark, sf_dir):
    """Amounts as text."""
    low, high = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey") * 7).otherwise(0), F.when(F.col("o_orderkey") % 5 > 1, F.col("o_orderkey") * 31)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), score.format_amount(low, high).alias("amount"))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE t = '{t}') AS \"{t}\"" for t in ("APPLY_NOW", "CONSIDER", "MONITOR", "SKIP", "INELIGIBLE"))


@query(f"WITH a AS (SELECT o_orderpriority AS source, {_TIER.format(s='o_orderkey % 50 / 10')} AS t FROM orders) SELECT source, {_COUNTS} FROM a GROUP BY source")
def tiers_by_source(spark, sf_dir):
    """A2: tiers as columns."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), score.tier(_part("o_orderkey", 50, 10), _no_flags()).alias("recommendation"))
    return report.tier_distribution(rows)


@query("SELECT o_custkey, o_orderkey, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def top_per_source(spark, sf_dir):
    """The first rows of each group."""
    return report.top_n_per(table(spark, sf_dir, "orders"), "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey", "rank")


@query("SELECT doc_id, sha256(coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), nullif(text, ''), '')) AS id FROM documents")
def surrogate_ids(spark, sf_dir):
    """Ids from the first of several columns that is not empty."""
    first = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", keys.surrogate_id(first, F.col("text")).alias("id"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AS is_latest FROM events")
def latest_rows(spark, sf_dir):
    """The last row of each key."""
    return merge.mark_latest(table(spark, sf_dir, "events"), "user_id", "event_id").select("event_id", "is_latest")


_SOURCE = "SELECT r.*, CASE WHEN o_totalprice > 300000 THEN 'APPLY_NOW' WHEN o_totalprice > 150000 THEN 'CONSIDER' ELSE 'SKIP' END AS tier, round(o_totalprice / 100000, 2) AS score FROM r JOIN orders ON o_orderkey = r.id"


@query(
    f"""WITH acts AS ({ORACLE_SQL["upsert_actions"]}), r AS ({_RECORDS}), s AS ({_SOURCE}),
made AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, id) AS n FROM (SELECT s.id, tier, score, 'new-' || sha256(coalesce(nullif(url, ''), nullif(title, ''), '')) AS page FROM s JOIN acts USING (id) WHERE action = 'create')),
best AS (SELECT page_id, tier, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, s.id) AS n FROM s JOIN acts USING (id) WHERE action IN ('update', 'merge')),
old AS (SELECT s.id, CASE WHEN o_orderstatus = 'F' THEN 'SKIP' ELSE tier END AS tier, score FROM s JOIN orders ON o_orderkey = s.id WHERE s.id IN (SELECT user_id FROM events))
SELECT page AS page_id, tier, score, 'New' AS status, DATE '{AS_OF}' AS scan_date FROM made WHERE n = 1
UNION ALL SELECT old.id::VARCHAR, coalesce(best.tier, old.tier), coalesce(best.score, old.score), 'Seen', DATE '1997-01-01' FROM old LEFT JOIN best ON best.page_id = old.id AND best.n = 1"""
)
def upsert_snapshot(spark, sf_dir):
    """The catalogue after the scored records have been put in."""
    price = F.col("o_totalprice")
    tier = F.when(price > 300000, "APPLY_NOW").when(price > 150000, "CONSIDER").otherwise("SKIP")
    src = records(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("id") == F.col("o_orderkey")).select("id", "title", "url", tier.alias("tier"), F.round(price / 100000, 2).alias("final_score"), F.coalesce("o_orderpriority", F.lit("")).alias("angle"), "o_orderstatus", F.lit(False).alias("researched"), F.lit(False).alias("not_a_grant"))
    old = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    tgt = src.join(old, "id").select(F.col("id").alias("page_id"), "title", "url", F.when(F.col("o_orderstatus") == "F", "SKIP").otherwise(F.col("tier")).alias("tier"), F.col("final_score").alias("score"), "angle", "researched", F.lit("Seen").alias("status"), F.lit("1997-01-01").cast("date").alias("scan_date"))
    return merge.upsert(src.drop("o_orderstatus"), tgt, _day())[1].select("page_id", "tier", "score", "status", "scan_date")
