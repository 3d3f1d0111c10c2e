"""Scores against organisation profiles: sub-scores, totals, tiers and their text form.

Every column that depends on the day takes ``as_of``. Profiles are a small
table, one row per organisation, broadcast to the records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oppflow.functions import fixed
from oppflow.functions.text import qualify_title, strip_marks
from oppflow.operators.rules import ineligibility, is_news, reject_reason

_STRINGS = T.ArrayType(T.StringType())
PROFILE = T.StructType(
    [T.StructField("org", T.StringType()), T.StructField("country", T.StringType()), T.StructField("willing", _STRINGS)]
    + [T.StructField(n, T.DoubleType()) for n in ("size_min", "size_max", "sweet_min", "sweet_max")]
    + [T.StructField("focus", _STRINGS), T.StructField("tags", _STRINGS)]
)
#: What the external judge replies.
JUDGEMENT = "mission_alignment double, competitive_fit double, strategic_fit double, best_projects array<string>, application_angle string, confidence string, reasoning string, clean_title string, corrected_deadline string, corrected_amount_max double, corrected_amount_min double, _not_a_grant boolean, _ineligible boolean"


def _text(*c: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in c]))


def _has(text: Column, word: Column, bounded: bool) -> Column:
    """Whether a word of a column occurs; the pattern is only tried where the letters stand at all."""
    some = F.contains(text, word)
    return some & F.regexp_like(text, F.concat(F.lit(r"(?<!\w)\Q"), word, F.lit(r"\E(?!\w)"))) if bounded else some


def _named(plain: Column, words: list[str], bounded: bool) -> Column:
    """Whether one of some words occurs."""
    some = reduce(lambda a, b: a | b, [F.contains(plain, F.lit(w)) for w in words])
    return some & plain.rlike(r"(?<!\w)(?:" + "|".join(words) + r")(?!\w)") if bounded else some


def place_score(text: Column, place: Column, word_bounded: bool = True) -> Column:
    """The part of the place score that no organisation changes: 0.85 down to 0.45 for none named. ``text`` is lower-cased."""

    def ladder(plain: Column) -> Column:
        has = lambda words: _named(plain, words, word_bounded)
        return F.when(has(fixed.CENTRAL), 0.85).when(has(fixed.LATIN) | F.coalesce(place == "LAC", F.lit(False)), 0.75).when(has(fixed.WORLD), 0.6).otherwise(0.45)

    # the text without marks is made once for all words
    return F.get(F.transform(F.array(strip_marks(text)), ladder), 0)


def geo_score(text: Column, place_part: Column, country: Column, willing: Column, word_bounded: bool = True) -> Column:
    """1 for the own country, 0.9 for one that the organisation works in, else ``place_part``. ``word_bounded`` off: parts of words count too."""
    near = F.exists(F.coalesce(willing, F.array().cast("array<string>")), lambda w: _has(text, F.lower(F.split(w, " ")[0]), word_bounded))
    return F.when(_has(text, F.lower(country), word_bounded), 1.0).when(near, 0.9).otherwise(place_part)


def size_score(amount_min: Column, amount_max: Column, low: Column, high: Column, sweet_low: Column, sweet_high: Column) -> Column:
    """0.8 times the fit of the amount to what the organisation can carry."""
    a = F.coalesce(F.nullif(amount_max, F.lit(0)), F.nullif(amount_min, F.lit(0))).cast("double")
    span = sweet_high - sweet_low
    share = F.when(span > 0, (a - sweet_low) / span).otherwise(1.0)
    fit = F.when(a.isNull(), 0.65).when(a < low, 0.4).when(a > high * 5, 0.2).when(a > high, 0.5).when(a.between(sweet_low, sweet_high), 0.85 + 0.15 * share).when(a < sweet_low, 0.75).otherwise(0.85)
    return 0.8 * fit


def days_left(deadline: Column, as_of: Column) -> Column:
    return F.datediff(deadline, as_of)


def deadline_score(deadline: Column, as_of: Column) -> Column:
    """0.7 times a ladder over the days left; no date counts as rolling."""
    d = days_left(deadline, as_of)
    return 0.7 * F.when(d.isNull(), 0.75).when(d < 0, 0.0).when(d < 15, 0.2).when(d < 30, 0.5).when(d < 60, 0.8).otherwise(1.0)


def org_type_score(title: Column, text: Column) -> Column:
    t = _text(title, text)
    fit = F.when(t.rlike(fixed.ORG_NORTHERN), 0.1).when(t.rlike(fixed.ORG_YOUTH), 1.0).when(t.rlike(fixed.ORG_LOCAL), 0.95).when(t.rlike(fixed.ORG_SOUTHERN), 0.9).otherwise(0.75)
    return 0.4 * fit


def partnership_score(title: Column, text: Column) -> Column:
    t = _text(title, text)
    return 0.3 * F.when(t.rlike(fixed.PARTNER_LEADS), 0.4).when(t.rlike(fixed.PARTNER_NEEDED), 0.7).when(t.rlike(fixed.PARTNER_OPTIONAL), 0.95).otherwise(1.0)


def with_profile(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every record with every organisation; ``profiles`` has one row for each."""
    return df.crossJoin(F.broadcast(profiles.select(F.struct(*PROFILE.fieldNames()).alias("profile"))))


def prescore(df: DataFrame, profiles: DataFrame, as_of: Column, word_bounded: bool = True) -> DataFrame:
    """Add ``org``, the five sub-scores (struct ``scores``), ``prescore``, ``flags`` and ``days_remaining``."""
    p = lambda n: F.col(f"profile.{n}")
    title, text = F.col("title"), F.col("description")
    hard = ineligibility(title, text, F.coalesce(F.col("amount_max"), F.lit(0)) != 0, F.col("deadline_date").isNotNull() | (F.col("deadline_kind") == "rolling"))
    # what only the record decides is found once, below the join with the organisations
    one = df.withColumn("_text", _text(title, text, F.col("country")))
    one = one.withColumns({"_hard": hard, "_place": place_score(F.col("_text"), F.col("country"), word_bounded), "_org_type": org_type_score(title, text), "_partnership": partnership_score(title, text)})
    out = with_profile(one, profiles)
    ok = F.col("_hard").isNull()
    zero = lambda c: F.when(ok, c).otherwise(0.0)
    scores = F.struct(
        zero(geo_score(F.col("_text"), F.col("_place"), p("country"), p("willing"), word_bounded)).alias("geo"),
        zero(size_score(F.col("amount_min"), F.col("amount_max"), p("size_min"), p("size_max"), p("sweet_min"), p("sweet_max"))).alias("size"),
        zero(deadline_score(F.col("deadline_date"), as_of)).alias("deadline"),
        zero(F.col("_org_type")).alias("org_type"),
        zero(F.col("_partnership")).alias("partnership"),
    )
    out = out.withColumn("scores", scores).withColumn("days_remaining", F.when(ok, days_left(F.col("deadline_date"), as_of)))
    flags = F.array_compact(F.array(F.col("_hard"), F.when(ok & (F.col("scores.geo") == 0), "INELIGIBLE_GEO"), F.when(F.col("days_remaining") < 15, "DEADLINE_TOO_CLOSE")))
    total = F.col("scores.geo") + F.col("scores.size") + F.col("scores.deadline") + F.col("scores.org_type") + F.col("scores.partnership")
    return out.withColumn("prescore", F.round(total, 2)).withColumn("flags", flags).withColumn("org", p("org")).drop("_hard", "_text", "_place", "_org_type", "_partnership", "profile")


def gate(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records worth judging, and the others with the reason."""
    why = reject_reason(F.col("flags"), F.col("days_remaining"), F.col("prescore"), is_news(F.col("title"), F.col("description"), F.col("url")))
    out = scored.withColumn("reason", why)
    return out.filter("reason IS NULL").drop("reason"), out.filter("reason IS NOT NULL")


def tier(score: Column, flags: Column, ineligible: Column | None = None) -> Column:
    """APPLY_NOW, CONSIDER, MONITOR, SKIP or INELIGIBLE."""
    hard = F.arrays_overlap(flags, F.array(*map(F.lit, fixed.HARD_FLAGS)))
    if ineligible is not None:
        hard = hard | F.coalesce(ineligible, F.lit(False))
    return F.when(hard, "INELIGIBLE").when(F.array_contains(flags, "DEADLINE_TOO_CLOSE"), "SKIP").when(score >= fixed.APPLY_FROM, "APPLY_NOW").when(score >= fixed.CONSIDER_FROM, "CONSIDER").when(score >= fixed.MONITOR_FROM, "MONITOR").otherwise("SKIP")


def combine(prescored: Column, mission: Column, competitive: Column, strategic: Column) -> Column:
    """The final score: rule and judged parts, rounded, at most 5."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return F.least(F.round(prescored + z(mission) + z(competitive) + z(strategic), 2), F.lit(fixed.MOST_SCORE))


def judge(df: DataFrame, judgements: DataFrame, id_col: str = "id") -> DataFrame:
    """Final scores from the judge's replies (``id, reply`` with JSON text); a broken reply counts as empty."""
    said = judgements.select(F.col(id_col), F.from_json("reply", JUDGEMENT, {"mode": "PERMISSIVE"}).alias("j"))
    out = df.join(said, id_col, "left")
    out = out.withColumn("final_score", combine(F.col("prescore"), F.col("j.mission_alignment"), F.col("j.competitive_fit"), F.col("j.strategic_fit")))
    return out.withColumn("recommendation", tier(F.col("final_score"), F.col("flags"), F.col("j._ineligible"))).withColumn("not_a_grant", F.coalesce(F.col("j._not_a_grant"), F.lit(False)))


def apply_corrections(df: DataFrame, judgements: DataFrame, id_col: str = "id") -> DataFrame:
    """Titles, deadlines and amounts that the judge corrected, then titles qualified by their funder."""
    j = judgements.select(F.col(id_col), F.from_json("reply", JUDGEMENT, {"mode": "PERMISSIVE"}).alias("_j"))
    out = df.join(j, id_col, "left")
    iso = F.col("_j.corrected_deadline").rlike(r"^\d{4}-\d{2}-\d{2}$")
    rolling = F.col("_j.corrected_deadline") == "rolling"
    fixed_title = F.when(F.length(F.trim("_j.clean_title")) > 3, F.trim("_j.clean_title")).otherwise(F.col("title"))
    amount = lambda n: F.when((F.col(f"_j.corrected_{n}") > 0) & (F.col(f"_j.corrected_{n}") < float("inf")), F.col(f"_j.corrected_{n}").cast("decimal(18,2)")).otherwise(F.col(n))
    return (
        out.withColumn("title", qualify_title(fixed_title, F.col("funder"), F.col("source")))
        .withColumn("deadline_kind", F.when(iso, "fixed").when(rolling, "rolling").otherwise(F.col("deadline_kind")))
        .withColumn("deadline_date", F.when(iso, F.try_to_date("_j.corrected_deadline")).when(rolling, F.lit(None).cast("date")).otherwise(F.col("deadline_date")))
        .withColumn("amount_max", amount("amount_max"))
        .withColumn("amount_min", amount("amount_min"))
        .drop("_j")
    )


def keyword_mission(title: Column, text: Column, focus: Column, tags: Column) -> Column:
    """1.2 times the share of five profile keywords that occur."""
    words = F.array_distinct(F.concat(F.flatten(F.transform(focus, lambda f: F.split(f, "_"))), tags))
    t = _text(title, text)
    n = F.size(F.filter(words, lambda w: F.contains(t, F.lower(w))))
    return F.round(1.2 * F.least(n / 5.0, F.lit(1.0)), 2)


def rule_only(prescored: Column, mission: Column, flags: Column) -> Column:
    """What to do with a record that nobody has judged."""
    total = prescored + mission
    return F.when(F.array_contains(flags, "INELIGIBLE_GEO"), "SKIP").when(total >= fixed.APPLY_FROM, "LIKELY_GOOD").when(total < 2.0, "SKIP").otherwise("REVIEW_MANUALLY")


#: Parts of the text form of a score, in order, and their columns.
PARTS = [("Geo", "geo"), ("Size", "size"), ("DL", "deadline"), ("Org", "org_type"), ("Partner", "partnership"), ("Align", "mission_alignment"), ("Compete", "competitive_fit"), ("Fit", "strategic_fit")]


def score_breakdown(parts: dict[str, Column], final: Column) -> Column:
    """One line of text; the competitive part only where it is known."""
    said = []
    for label, name in PARTS:
        c = parts[name]
        form = "%+.2f" if label in ("Compete", "Fit") else "%.2f"
        text = F.concat(F.lit(f"{label}:"), F.format_string(form, c if label == "Compete" else F.coalesce(c, F.lit(0.0))))
        said.append(F.when(c.isNotNull(), text) if label == "Compete" else text)
    return F.concat(F.concat_ws(" | ", *said), F.format_string(" = %.2f", F.coalesce(final, F.lit(0.0))))


def parse_breakdown(c: Column) -> Column:
    """The numbers of such a line; missing parts are 0."""
    return F.struct(*[F.coalesce(F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?:^|[ |]){label}:([+-]?\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0)).alias(name) for label, name in PARTS])


def rescore(df: DataFrame, judgements: DataFrame, id_col: str = "id", breakdown_col: str = "breakdown") -> DataFrame:
    """Final score and tier from a stored line with the two judged parts replaced; the strategic part is kept."""
    new = judgements.select(F.col(id_col), F.col("mission_alignment").alias("_m"), F.col("competitive_fit").alias("_c"))
    out = df.withColumn("_p", parse_breakdown(F.col(breakdown_col))).join(new, id_col)
    rules = F.round(F.col("_p.geo") + F.col("_p.size") + F.col("_p.deadline") + F.col("_p.org_type") + F.col("_p.partnership"), 2)
    out = out.withColumn("final_score", combine(rules, F.col("_m"), F.col("_c"), F.col("_p.strategic_fit")))
    return out.withColumn("recommendation", tier(F.col("final_score"), F.array().cast("array<string>"))).drop("_p", "_m", "_c")


def is_stale(researched_at: Column, score_then: Column, score_now: Column, as_of: Column) -> Column:
    """Old, and the score has moved; false where anything is unknown."""
    old = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(researched_at) >= fixed.STALE_DAYS * 86400
    return F.coalesce(old & (F.abs(score_now - score_then) >= fixed.STALE_DRIFT), F.lit(False))


def effective_tier(recommendation: Column, research: Column, stale: Column) -> Column:
    """The researched verdict unless it is stale."""
    return F.when(research.isNotNull() & ~stale, research).otherwise(recommendation)


def tier_order(t: Column, flags: Column | None = None) -> Column:
    hard = t == "INELIGIBLE"
    if flags is not None:
        hard = hard | F.arrays_overlap(flags, F.array(*map(F.lit, fixed.HARD_FLAGS)))
    return F.when(hard, 5).when(t == "APPLY_NOW", 0).when(t == "CONSIDER", 1).when(t == "MONITOR", 2).otherwise(3)


def timing_gate(t: Column, closed: Column, reopens: Column) -> Column:
    """A closed call that does not reopen within a year is nothing to act on now."""
    return F.when((t == "APPLY_NOW") & F.coalesce(closed, F.lit(False)) & ~F.coalesce(reopens, F.lit(False)), "CONSIDER").otherwise(t)


def tier_from_likelihood(percent: Column) -> Column:
    return F.when(percent >= 40, "APPLY_NOW").when(percent >= 20, "CONSIDER").when(percent >= 10, "MONITOR").otherwise("SKIP")


def aging_bonus(scanned: Column, as_of: Column) -> Column:
    """0.15 a week since the record was first listed, at most 1."""
    days = (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(scanned.cast("timestamp"))) / 86400.0
    return F.coalesce(F.least(F.greatest(days / 7 * fixed.AGING_PER_WEEK, F.lit(0.0)), F.lit(fixed.AGING_MOST)), F.lit(0.0))


def research_status(closed: Column, evidence: Column) -> Column:
    return F.when(closed, "Closed").when(~closed & (F.coalesce(evidence, F.lit("")) != ""), "Open").otherwise("Could not confirm")


def format_amount(low: Column, high: Column) -> Column:
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    low, high = F.nullif(low, F.lit(0)), F.nullif(high, F.lit(0))
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(money(low), F.lit(" – "), money(high))).when(high.isNotNull(), F.concat(F.lit("Up to "), money(high))).when(low.isNotNull(), F.concat(F.lit("From "), money(low))).otherwise("Amount unknown")


def deadline_note(deadline: Column, as_of: Column) -> Column:
    """Closed, days left in three steps of urgency, or rolling."""
    d = days_left(deadline, as_of)
    day = F.date_format(deadline, "MMM d, yyyy")
    return F.when(d.isNull(), "Rolling").when(d < 0, F.concat(F.lit("Closed ("), day, F.lit(")"))).when(d <= 14, F.concat(F.lit("Urgent: "), day, F.lit(" ("), d.cast("string"), F.lit("d left)"))).when(d <= 45, F.concat(F.lit("Soon: "), day, F.lit(" ("), d.cast("string"), F.lit("d)"))).otherwise(F.concat(F.lit("Later: "), day, F.lit(" ("), d.cast("string"), F.lit("d)")))


def deadline_fields(best: Column, confidence: Column, as_of: Column) -> Column:
    """A researched date (or ``rolling``) as a date and a note that says how sure it is."""
    date = F.when(best.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(best))
    note = deadline_note(date, as_of)
    note = F.when(confidence == "estimated_annual", F.concat(F.lit("≈ "), note, F.lit(" (estimated)"))).when(confidence == "historical", F.concat(note, F.lit(" (last known date; next round not confirmed)"))).otherwise(note)
    return F.struct(date.alias("deadline_date"), F.when(date.isNotNull(), note).when(best == "rolling", "Rolling").alias("deadline_note"))


def prompt_table(df: DataFrame, template: str, id_col: str = "id", text_chars: int = 800) -> DataFrame:
    """``id, prompt``: the template with ``{column}`` filled from each row; the description is cut to ``text_chars``."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    filled = [F.lit(p) if k % 2 == 0 else F.coalesce(F.substring(p, 1, text_chars) if p == "description" else F.col(p).cast("string"), F.lit("unknown")) for k, p in enumerate(parts)]
    return df.select(id_col, F.concat(*filled).alias("prompt"))
