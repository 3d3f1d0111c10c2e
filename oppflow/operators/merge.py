"""Filling from caches, merging candidates, and upserting into a long-lived catalogue snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oppflow.functions import keys
from oppflow.operators import resolve
from oppflow.operators.history import first_wins
from oppflow.operators.score import effective_tier, is_stale
from oppflow.shared import materialize


def fill_from_cache(df: DataFrame, cache: DataFrame, ttl_days: int, as_of: Column, key: str = "url") -> DataFrame:
    """Nulls of deadline and amounts from a cache (``url, deadline_date, deadline_kind, amount_min, amount_max, fetched_at``).

    Only rows that lack a fixed deadline or an amount, and only entries that are
    fresh; a rolling deadline is trusted but for newsletters. What is left
    without any deadline is rolling.
    """
    fresh = cache.filter(F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp("fetched_at") < ttl_days * 86400)
    newest = first_wins(fresh, [key], [F.col("fetched_at").desc()]).filter(F.col(key).isNotNull())
    c = newest.select(F.col(key), F.col("deadline_date").alias("_d"), F.col("deadline_kind").alias("_k"), F.col("amount_min").alias("_lo"), F.col("amount_max").alias("_hi"))
    trusted = F.col("deadline_date").isNotNull() | ((F.col("deadline_kind") == "rolling") & (F.coalesce("type", F.lit("")) != "newsletter"))
    need = ~F.coalesce(trusted, F.lit(False)) | F.col("amount_max").isNull()
    out = df.join(c, key, "left")
    date = F.when(need & F.col("deadline_date").isNull() & ~F.coalesce(trusted, F.lit(False)), F.col("_d")).otherwise(F.col("deadline_date"))
    lo = F.when(need, F.coalesce("amount_min", "_lo")).otherwise(F.col("amount_min"))
    hi = F.when(need, F.coalesce("amount_max", "_hi")).otherwise(F.col("amount_max"))
    return out.withColumn("_date", date).withColumn("amount_min", lo).withColumn("amount_max", hi).withColumn("deadline_date", F.col("_date")).withColumn("deadline_kind", F.when(F.col("_date").isNotNull(), "fixed").otherwise("rolling")).drop("_d", "_k", "_lo", "_hi", "_date")


def merge_candidates(df: DataFrame, key: str = "id", order: str = "rank") -> DataFrame:
    """Several result rows per record in one: the first amount, the first fixed deadline, all themes.

    ``ttl_days`` says how long the result holds: 7 if complete, 2 if partly, else 1.
    """
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    out = df.groupBy(key).agg(first("amount_min"), first("amount_max"), first("deadline_date"), F.bool_or(F.col("deadline_kind") == "rolling").alias("_rolling"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("themes")))).alias("themes"))
    has = F.col("deadline_date").isNotNull().cast("int") + F.col("amount_max").isNotNull().cast("int")
    return out.withColumn("deadline_kind", F.when(F.col("deadline_date").isNotNull(), "fixed").when(F.col("_rolling"), "rolling").otherwise("unknown")).withColumn("ttl_days", F.when(has == 2, 7).when(has == 1, 2).otherwise(1)).drop("_rolling")


def replace_by_key(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``base`` with all rows of the keys in ``new`` taken out and the new rows put in."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_first_wins(base: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``base`` and the first row of each new key; new rows without a key are dropped."""
    some = first_wins(new.filter(F.col(key).isNotNull()), [key], order)
    return base.unionByName(some.join(base.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def needs_update(tier_then: Column, tier_now: Column, score_then: Column, score_now: Column, angle_then: Column, angle_now: Column, researched_then: Column, researched_now: Column) -> Column:
    """Tier or angle changed, the score moved by over 0.05, or research is new."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return ~tier_then.eqNullSafe(tier_now) | (F.abs(F.coalesce(score_then, F.lit(0.0)) - F.coalesce(score_now, F.lit(0.0))) > 0.05) | (text(angle_then) != text(angle_now)) | (F.coalesce(researched_now, F.lit(False)) & ~F.coalesce(researched_then, F.lit(False)))


def attach_research(df: DataFrame, research: DataFrame, as_of: Column, score_col: str = "final_score") -> DataFrame:
    """Add ``researched``, ``verdict`` and ``tier`` (the researched verdict unless stale) by ``research_key``."""
    r = first_wins(research, ["research_key"], [F.col("researched_at").desc_nulls_last()]).select("research_key", F.col("recommendation").alias("verdict"), "researched_at", "scored_at_score")
    key = keys.research_key(keys.fingerprint(F.col("title"), F.col("url")), F.col("id"))
    out = df.withColumn("research_key", key).join(r, "research_key", "left")
    stale = is_stale(F.col("researched_at"), F.col("scored_at_score"), F.col(score_col), as_of)
    return out.withColumn("researched", F.col("verdict").isNotNull()).withColumn("tier", effective_tier(F.col("recommendation"), F.col("verdict"), stale)).drop("researched_at", "scored_at_score")


def classify_upsert(source: DataFrame, target: DataFrame) -> DataFrame:
    """``source`` with ``page_id`` (the catalogue row it belongs to, or null) and ``action``.

    ``source``: id, title, url, tier, final_score, angle, researched, not_a_grant;
    ``target``: page_id, title, url, tier, score, angle, researched. A row belongs
    to the first page with its identity key, unless that is another program on
    the same host; else to the first page that it matches by the rules.
    Actions: create, update, unchanged, merge (by the rules) or not_a_grant.
    """
    ident = keys.identity_key(keys.fingerprint(F.col("title"), F.col("url")), F.col("url"))
    own = materialize(resolve.with_keys(source.withColumn("_ident", ident), name="_k"), "source")
    pages = materialize(resolve.with_keys(target.select("page_id", "title", "url", ident.alias("_ident")), name="_pk").select("page_id", "_ident", "_pk"), "target")
    by_key = first_wins(pages.filter("_ident IS NOT NULL"), ["_ident"], [F.col("page_id")]).select("_ident", F.col("page_id").alias("_exact"), "_pk")
    void = F.coalesce(resolve.different_program(F.col("_k"), F.col("_pk")), F.lit(False))
    rows = materialize(own.join(by_key, "_ident", "left").withColumn("_exact", F.when(~void, F.col("_exact"))).drop("_pk", "_ident"), "exact")
    misses = rows.filter("_exact IS NULL AND NOT coalesce(not_a_grant, false)").select("id", F.col("_k").alias("k"))
    fuzzy = resolve.match_keyed(misses, pages.select(F.col("page_id").alias("id"), F.col("_pk").alias("k"))).groupBy("id_a").agg(F.min("id_b").alias("_fuzzy"))
    rows = rows.drop("_k")
    rows = rows.join(fuzzy, rows["id"] == fuzzy["id_a"], "left").drop("id_a").withColumn("page_id", F.coalesce("_exact", "_fuzzy"))
    then = target.select("page_id", F.col("tier").alias("_tier"), F.col("score").alias("_score"), F.col("angle").alias("_angle"), F.col("researched").alias("_researched"))
    rows = rows.join(then, "page_id", "left")
    changed = needs_update(F.col("_tier"), F.col("tier"), F.col("_score"), F.col("final_score"), F.col("_angle"), F.col("angle"), F.col("_researched"), F.col("researched"))
    action = F.when(F.coalesce("not_a_grant", F.lit(False)), "not_a_grant").when(F.col("_exact").isNotNull() & changed, "update").when(F.col("_exact").isNotNull(), "unchanged").when(F.col("_fuzzy").isNotNull(), "merge").otherwise("create")
    return rows.withColumn("action", action).drop("_exact", "_fuzzy", "_tier", "_score", "_angle", "_researched")


def upsert(source: DataFrame, target: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """The action of each source row, and the new snapshot.

    New rows get status New and today's scan date; pages that are updated or
    merged keep theirs. Several rows of one page: the best score, then the least id.
    """
    acted = classify_upsert(source, target)
    fresh = acted.filter("action IN ('create', 'update', 'merge')")
    made = fresh.filter("action = 'create'").withColumn("page_id", F.concat(F.lit("new-"), keys.surrogate_id(F.col("url"), F.col("title"))))
    made = first_wins(made, ["page_id"], [F.col("final_score").desc_nulls_last(), F.col("id")])
    cols = [F.col("page_id").cast("string").alias("page_id"), "title", "url", "tier", F.col("final_score").alias("score"), "angle", "researched"]
    new = made.select(*cols, F.lit("New").alias("status"), as_of.cast("date").alias("scan_date"))
    best = first_wins(fresh.filter("action <> 'create'"), ["page_id"], [F.col("final_score").desc_nulls_last(), F.col("id")])
    old = target.select(F.col("page_id").cast("string").alias("page_id"), "title", "url", "tier", "score", "angle", "researched", "status", "scan_date")
    changed = best.select(*cols).join(old.select("page_id", "status", "scan_date"), "page_id")
    return acted, old.join(changed.select("page_id"), "page_id", "left_anti").unionByName(changed).unionByName(new)


def catalogue_candidates(snapshot: DataFrame, fresh: DataFrame, tiers: list[str]) -> DataFrame:
    """Catalogue rows of some tiers as records, less those that are among the fresh ones by address or title, and the fresh ones."""
    known = fresh.select(F.coalesce(F.nullif("url", F.lit("")), "title").alias("_k")).distinct()
    amount = F.regexp_replace(F.regexp_extract(F.coalesce(F.col("amount_text"), F.lit("")), r"(?<!\d)(?<!\d,)(\d[\d,]*+)\s*+$", 1), ",", "").try_cast("decimal(18,2)")
    back = snapshot.filter(F.col("tier").isin(tiers)).withColumn("_k", F.coalesce(F.nullif("url", F.lit("")), "title")).join(known, "_k", "left_anti")
    back = back.select(F.col("page_id").cast("string").alias("id"), "title", "url", amount.alias("amount_max"), F.concat_ws("\n", "summary", "notes").alias("description"), F.col("score").alias("final_score"), F.col("tier").alias("recommendation"), "scan_date", "pinned")
    return fresh.withColumn("id", F.col("id").cast("string")).unionByName(back, allowMissingColumns=True)


def mark_latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Add ``is_latest``: the last row of each key."""
    return df.withColumn("is_latest", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc())) == 1)
