"""Counts, rankings, work lists and health reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oppflow.functions import fixed
from oppflow.operators.score import aging_bonus, tier_order

#: Columns of the ranked export.
EXPORT = ["title", "funder", "source", "url", "country", "amount_min", "amount_max", "deadline_date", "days_remaining", "final_score", "recommendation", "flags", "best_projects", "application_angle", "confidence", "reasoning"]


def counts(df: DataFrame, by: str) -> DataFrame:
    """Rows of each value, largest first (ties by value)."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def source_counts(df: DataFrame, by: str = "source", repeat: str = "is_repeat", queued: str = "is_queued") -> DataFrame:
    """Raw, repeated and queued rows of each source."""
    return df.groupBy(by).agg(F.count("*").alias("raw"), F.count_if(F.col(repeat)).alias("repeats"), F.count_if(F.col(queued)).alias("queued"))


def tier_distribution(df: DataFrame, by: str = "source", tier: str = "recommendation") -> DataFrame:
    """Tiers as columns, a row for each source."""
    return df.groupBy(by).pivot(tier, ["APPLY_NOW", "CONSIDER", "MONITOR", "SKIP", "INELIGIBLE"]).count().na.fill(0)


def run_totals(df: DataFrame) -> DataFrame:
    """One row of totals over ``recommendation, final_score``."""
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("recommendation") == "APPLY_NOW").alias("apply_now"), F.count_if(F.col("recommendation") == "CONSIDER").alias("consider"), F.round(F.avg("final_score"), 4).alias("mean_score"), F.max("final_score").alias("best_score"))


def researched_on(research: DataFrame, as_of: Column) -> DataFrame:
    return research.filter(F.to_date("researched_at") == as_of).agg(F.count("*").alias("n"))


def rank_by(df: DataFrame, id_col: str = "id", score: str = "final_score", tier: str | None = None) -> DataFrame:
    """Best score first, or by tier and then score; ties by id."""
    order = [F.col(score).desc_nulls_last(), F.col(id_col)]
    return df.orderBy(*([tier_order(F.col(tier))] if tier else []), *order)


def top_n(df: DataFrame, n: int, id_col: str = "id", score: str = "final_score") -> DataFrame:
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(id_col)).limit(n)


def top_n_per(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, with ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= n)


def tier_report(df: DataFrame, caps: dict[str, int] | None = None, id_col: str = "id") -> DataFrame:
    """``tier, tier_size, rank`` and the row, tier by tier; some tiers are capped."""
    caps = {"MONITOR": 10} if caps is None else caps
    w = Window.partitionBy("recommendation")
    out = df.filter(F.col("recommendation").isin("APPLY_NOW", "CONSIDER", "MONITOR"))
    out = out.withColumn("tier_size", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col("final_score").desc_nulls_last(), id_col)))
    cap = F.coalesce(*[F.when(F.col("recommendation") == t, n) for t, n in caps.items()], F.lit(2**31 - 1))
    return out.filter(F.col("rank") <= cap)


def ranked_export(df: DataFrame) -> DataFrame:
    """The export's columns, best first, tabs and line ends out of the texts; rows without a score are dropped."""
    have = dict(df.dtypes)
    clean = lambda c: F.regexp_replace(c, r"[\t\r\n]+", " ")
    cols = []
    for c in EXPORT:
        kind = have.get(c)
        if kind is None:
            cols.append(F.lit(None).cast("string").alias(c))
        elif kind.startswith("array"):
            cols.append(clean(F.array_join(c, ", ")).alias(c))
        else:
            cols.append((clean(F.col(c)) if kind == "string" else F.col(c)).alias(c))
    return df.filter("final_score IS NOT NULL").orderBy(F.desc("final_score"), "title").select(cols)


def write_ranked(df: DataFrame, path: str) -> None:
    """The export as tab-separated files."""
    ranked_export(df).write.mode("overwrite").csv(path, sep="\t", header=True)


def select_near_miss(snapshot: DataFrame, limit: int = 8) -> tuple[DataFrame, DataFrame]:
    """The best unchecked records just below the lowest tier, and how many more there are."""
    band = snapshot.filter((F.col("tier") == "SKIP") & (F.col("score") >= fixed.NEAR_MISS_FLOOR) & (F.col("score") < fixed.MONITOR_FROM) & ~F.coalesce("near_miss_checked", F.lit(False)) & ~F.coalesce(F.col("url"), F.lit("")).rlike(r"(?i)(^|\.|//)linkedin\.com/"))
    return top_n(band, limit, "page_id", "score"), band.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("remaining"))


def select_research(df: DataFrame, as_of: Column, limit: int = 5, pinned: int = 2, id_col: str = "id") -> DataFrame:
    """The next records to look into: up to ``pinned`` pinned ones first, then by score and waiting time.

    Eligible are the three upper tiers, not yet researched or stale.
    """
    able = df.filter(F.col("recommendation").isin("APPLY_NOW", "CONSIDER", "MONITOR") & (~F.coalesce("researched", F.lit(False)) | F.coalesce("stale", F.lit(False))))
    able = able.withColumn("priority", F.col("final_score") + aging_bonus(F.col("scan_date"), as_of))
    order = [F.col("priority").desc_nulls_last(), F.col(id_col)]
    first = able.filter(F.coalesce("pinned", F.lit(False))).orderBy(*order).limit(pinned).withColumn("slot", F.lit(0))
    rest = able.join(first.select(id_col), id_col, "left_anti").withColumn("slot", F.lit(1))
    return first.unionByName(rest).orderBy("slot", *order).limit(limit)


def append_status(spark, status: DataFrame, history_path: str) -> None:
    """Add a run's status rows to the history; files are only added."""
    status.write.mode("append").parquet(history_path)


def keep_last(history: DataFrame, n: int = 10, run: str = "ran_at") -> DataFrame:
    """Rows of the last ``n`` runs."""
    last = history.select(run).distinct().orderBy(F.desc(run)).limit(n)
    return history.join(F.broadcast(last), run)  # n rows


def run_delta(history: DataFrame, by: str = "source", run: str = "ran_at", n: str = "fetched") -> DataFrame:
    """Add the previous run's count and ``dropped`` (had rows, has none)."""
    before = F.lag(n).over(Window.partitionBy(by).orderBy(run))
    return history.withColumn("previous", before).withColumn("dropped", F.coalesce((F.col("previous") > 0) & (F.col(n) == 0), F.lit(False)))


def run_report(status: DataFrame, registry: DataFrame, history: DataFrame) -> DataFrame:
    """State of each registry entry: ok, empty, failed, missing or off; and status rows that no entry names.

    ``status``: source, ok, error, raw, repeats, queued; ``registry``: name,
    enabled, sources (array); ``history``: source, ran_at, fetched of earlier runs.
    """
    named = registry.select("name", "enabled", F.explode_outer("sources").alias("source"))
    last = history.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("ran_at")))).filter("_n = 1").select("source", F.col("fetched").alias("before"))
    rows = named.join(status, "source", "left").join(last, "source", "left")
    out = rows.groupBy("name", "enabled").agg(
        F.count("raw").alias("reported"), F.bool_or(~F.col("ok")).alias("failed"), F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("repeats"), F.lit(0)).alias("repeats"), F.coalesce(F.sum("queued"), F.lit(0)).alias("queued"),
        F.bool_or((F.col("before") > 0) & (F.coalesce("raw", F.lit(0)) == 0)).alias("dropped"),
    )
    state = F.when(~F.col("enabled"), "off").when(F.col("reported") == 0, "missing").when(F.col("failed"), "failed").when(F.col("raw") == 0, "empty").otherwise("ok")
    out = out.select("name", state.alias("state"), "raw", "repeats", "queued", F.coalesce("dropped", F.lit(False)).alias("dropped"))
    other = status.join(named.select("source").distinct(), "source", "left_anti").select(F.col("source").alias("name"), F.lit("unregistered").alias("state"), "raw", "repeats", "queued", F.lit(False).alias("dropped"))
    return out.unionByName(other)


def overall_state(report: DataFrame) -> DataFrame:
    """``ok`` if every entry that is on is ok, ``failed`` if none is, else ``partial``."""
    on = report.filter("state NOT IN ('off', 'unregistered')")
    good = F.col("state") == "ok"
    return on.agg(F.when(F.count("*") == 0, "failed").when(F.every(good), "ok").when(F.some(good), "partial").otherwise("failed").alias("state"), F.bool_or("dropped").alias("dropped"))


def feed_metrics(posts: DataFrame, by: str = "source_name") -> DataFrame:
    """Fetched, seen, new and relevant posts of each page."""
    return posts.groupBy(by).agg(F.count("*").alias("fetched"), F.count_if("is_seen").alias("seen"), F.count_if(~F.col("is_seen")).alias("new"), F.count_if(~F.col("is_seen") & F.col("is_relevant")).alias("relevant"))


def repeat_audit(df: DataFrame, pairs_in_run: DataFrame, known: DataFrame, catalogue_hits: DataFrame, id_col: str = "id") -> DataFrame:
    """Each row as a repeat in the run, known, in the catalogue, or new; with counts of each.

    ``pairs_in_run``: ``id_a, id_b``; ``known`` and ``catalogue_hits``: ids.
    """
    flag = lambda d, name: d.select(F.col(d.columns[0]).alias(id_col)).distinct().withColumn(name, F.lit(True))
    out = df.select(id_col).join(flag(pairs_in_run.select("id_b"), "r"), id_col, "left").join(flag(known, "k"), id_col, "left").join(flag(catalogue_hits, "c"), id_col, "left")
    state = F.when(F.col("r"), "repeat in run").when(F.col("k"), "known").when(F.col("c"), "in catalogue").otherwise("new")
    return out.select(id_col, state.alias("state"))
