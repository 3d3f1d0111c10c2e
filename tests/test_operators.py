"""Extraction, splitting, rules, scores, selection and reports, on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from oppflow.operators import extract, merge, report, rules, score, segment
from oppflow.sources import landing

def day():
    return F.lit("2026-06-01").cast("date")


def one(spark, col, text):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "date", "kind"),
    [
        ("Deadline: October 31, 2026 at noon", "2026-10-31", "fixed"), ("Fecha límite: 7 de agosto de 2026", "2026-08-07", "fixed"), ("convocatoria abierta hasta el 3 de septiembre de 2026", "2026-09-03", "fixed"),
        ("permanente (Rolling Basis)", None, "rolling"), ("deadline: 2026-13-45, then 2026-12-02", None, "unknown"), ("due by March 5 2027", "2027-03-05", "fixed"), ("apply 12/25/2026", "2026-12-25", "fixed"), ("nothing here", None, "unknown"), (None, None, "unknown"),
    ],
)
def test_deadlines(spark, text, date, kind):
    got = one(spark, extract.extract_deadline, text)
    assert (str(got.deadline_date) if got.deadline_date else None, got.deadline_kind) == (date, kind)


@pytest.mark.parametrize(
    ("text", "low", "high"),
    [("Up to $2.5k", None, 2500), ("Prize of $150k", None, 150000), ("Hasta USD 1.2M", None, 1200000), ("grants of $5,000", None, 5000), ("USD 10,000 to USD 900,000", 10000, 900000), ("in 2026 we met", None, None), ("$50", None, None), ("annual budget under USD 500,000; award up to $20,000", None, 20000)],
)
def test_amounts(spark, text, low, high):
    got = one(spark, extract.extract_amount, text)
    assert (got.amount_min and int(got.amount_min), got.amount_max and int(got.amount_max)) == (low, high)


def test_small_extractors(spark):
    assert one(spark, extract.detect_currency, "Hasta AU$30.000") == "AUD"
    assert one(spark, extract.hashtags, "#Fund and #Clima #fund") == ["fund", "clima"]
    assert one(spark, extract.split_title_funder, "Climate action callGreen Foundation").funder == "Green Foundation"
    assert one(spark, extract.mentioned_orgs, "with The Green Planet Foundation and Big Green Planet Foundation") == ["Green Planet Foundation"]
    assert one(spark, extract.markdown_parts, "see [the call](https://x.org/a) ![i](https://y.org/b.png)").links[0].url == "https://x.org/a"
    assert one(spark, lambda c: extract.snippet_after(c, ["eligibility", "who can apply"]), "Eligibility: NGOs in Latin America") == "NGOs in Latin America"
    assert one(spark, lambda c: extract.published_at(c, F.lit("2026-06-15 00:00:00").cast("timestamp")), "2w") == dt.datetime(2026, 6, 1)
    assert one(spark, lambda c: extract.infer_year(F.lit(1), F.lit(15), F.lit("2026-11-20").cast("date")), "") == dt.date(2027, 1, 15)
    assert one(spark, lambda c: extract.signals(c, [("water", "agua|water"), ("land", "tierra")], "first"), "tierra y agua") == "water"


def test_posts_are_segmented(spark):
    arrow = "Calls this week\n➡️ Green Fund\nDeadline October 31, 2026, up to $2,500\n➡️ Blue Prize https://b.org\n➡️ Red Award closes 18 December 2026\n\nFollow us for more"
    numbered = "1. One grant https://a.org\n2. Two grant https://b.org\n3. Three fund https://c.org\n4. Four fund $5,000"
    plain = "A single call: deadline 3 May 2026\n• benefit one\n• benefit two"
    df = spark.createDataFrame([(1, arrow), (2, numbered), (3, plain), (4, None)], "post_id long, post_text string")
    got = segment.segment_posts(df).groupBy("post_id").count().collect()
    assert {r.post_id: r["count"] for r in got} == {1: 3, 2: 4, 3: 1, 4: 1}
    last = segment.segment_posts(df).filter("post_id = 1 AND segment = 3").first()
    assert "Follow us" not in last.text


def test_newsletters(spark):
    labelled = "Hello\n\nOcean Call – Sea Trust\nDeadline: July 31, 2026\nFunding: $100,000\n\nbye\nNote: nothing"
    got = segment.segment_labelled(spark.createDataFrame([(1, labelled)], "message_id long, body string")).collect()
    assert [(r.title, r.fields["deadline"]) for r in got] == [("Ocean Call – Sea Trust", "July 31, 2026")]
    bracketed = "[Global] Creators Fund: Stanley 1913: up to $50,000 by 2026-09-13\n[LAC] Sea Trust: Reef Call: rolling\n[LAC] Sea Trust: Reef Call: again\n\nUnsubscribe here"
    regions = spark.createDataFrame([("LAC", "Latin America")], "region string, country string")
    got = segment.segment_bracketed(spark.createDataFrame([(1, bracketed)], "message_id long, body string"), regions).orderBy("pos").collect()
    assert [(r.funder, r.title, r.country) for r in got] == [("Creators Fund", "Stanley 1913", None), ("Sea Trust", "Reef Call", "Latin America")]


def test_feed_pages_links_and_digests(spark):
    page = "Company\n## Updates\nfirst post 3d text\n---\nno age here\n---\nsecond post 2w text"
    assert segment.segment_feed_page(spark.createDataFrame([(1, page)], "page_id long, markdown string")).count() == 2
    links = spark.createDataFrame([(1, "https://x.org", "x.org", "see", 1), (1, "mailto:a@b", "x.org", "see", 1), (1, "https://y.org/call", "x.org", "subscribe to our list https", 24), (1, "https://y.org/call", "x.org", "read", 1)], "post_id long, url string, own_host string, text string, idx int")
    assert [r.junk for r in segment.classify_links(links).collect()] == ["own site", "mailto", "call to action", None]
    seg = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10, 30)], "post_id long, segment int, start int, end int")
    assert {r.segment for r in segment.links_to_segments(links.filter("idx = 24"), seg).collect()} == {2}
    rec = spark.createDataFrame([("d", "10 grants this week", "https://d.org"), ("e", "Digest of nothing", "https://e.org"), ("r", "Real call", "https://r.org")], "id string, title string, url string")
    ent = spark.createDataFrame([("d", "One", "https://one.org", "$5,000"), ("d", "Known", "https://r.org", "$5,000"), ("d", "Bare", "https://bare.org", "short")], "digest_id string, title string, url string, context string")
    assert sorted(r.title for r in segment.expand_digests(rec, ent).collect()) == ["Digest of nothing", "One", "Real call"]


NOT_A_CALL = ["Thank you for joining us", "Workshop recap: water", "Premium membership", "Grant writing course", "Masterclass in finance", "Webinar on climate", "Internship at X", "Resource directory", "Open day (not a grant)"]


def test_reasons(spark):
    rows = [(t, "") for t in NOT_A_CALL] + [("Climate fund for Kenya", ""), ("Global fund, Kenya", "a call for proposals with a long text so that it is not short"), ("Beca para estudiar", ""), ("Open call for youth grants", "apply by May")]
    df = spark.createDataFrame(rows, "title string, description string")
    no = F.lit(False)
    got = [r.x for r in df.select(rules.ineligibility(F.col("title"), F.col("description"), no, no).alias("x")).collect()]
    # a bare webinar is a course first
    assert got == ["NOT_A_GRANT"] * 5 + ["COURSE_NOT_GRANT"] + ["NOT_A_GRANT"] * 3 + ["WRONG_GEOGRAPHY", None, "SCHOLARSHIP_ONLY", None]
    strong, weak, cue = ["convocatoria", "grant"], ["fondo"], ["aplica"]
    texts = ["#grant #fund only tags", "para difundir", "un fondo nuevo", "un fondo nuevo, aplica ya", "Convocatoria abierta"]
    got = [one(spark, lambda c: rules.is_relevant(c, strong, weak, cue), t) for t in texts]
    assert got == [False, False, False, True, True]
    df = spark.createDataFrame([("1", "marine grant"), ("2", "nothing")], "id string, title string")
    table = spark.createDataFrame([(1, "marine", "marine", 0.9), (2, "any", "grant", 0.5)], "priority int, name string, pattern string, weight double")
    assert {r.id: (r.rule_score, r.rule_names) for r in rules.rule_table_score(df, table, F.col("title")).collect()} == {"1": (0.9, ["any", "marine"]), "2": (0.2, [])}


def test_scores(spark):
    df = spark.range(1)
    f = lambda c: df.select(c.alias("x")).first().x
    d = lambda x: F.lit(x).cast("double")
    none = F.array().cast("array<string>")
    total = score.combine(d(2.0), d(1.1), d(-0.1), d(0.05))
    assert (f(total), f(score.tier(total, none))) == (3.05, "MONITOR")
    assert f(score.tier(d(4.0), F.array(F.lit("NOT_A_GRANT")))) == "INELIGIBLE"
    assert f(score.size_score(d(None), d(100), d(50), d(200), d(80), d(120))) == pytest.approx(0.8 * 0.925)
    assert [f(score.deadline_score(F.date_add(day(), n), day())) for n in (-1, 0, 15, 30, 60)] == pytest.approx([0, 0.14, 0.35, 0.56, 0.7])
    line = "Geo:1.00 | Size:0.80 | DL:0.70 | Org:0.40 | Partner:0.30 | Align:0.10 | Compete:-0.20 | Fit:+0.00"
    p = f(score.parse_breakdown(F.lit(line)))
    assert p.geo + p["size"] + p.deadline + p.org_type + p.partnership == pytest.approx(3.2) and p.competitive_fit == -0.2
    assert set(f(score.parse_breakdown(F.lit(""))).asDict().values()) == {0.0} and f(score.parse_breakdown(F.lit("Fit:-0.10"))).strategic_fit == -0.1
    ago = lambda n: F.date_sub(day(), n).cast("timestamp")
    stale = [f(score.is_stale(ago(10), d(1), d(4), day())), f(score.is_stale(ago(120), d(1), d(1.1), day())), f(score.is_stale(ago(120), d(1), d(2.71), day())), f(score.is_stale(F.lit(None).cast("timestamp"), d(1), d(3), day()))]
    assert stale == [False, False, True, False]
    assert [f(score.aging_bonus(x, day())) for x in (F.lit(None).cast("date"), F.date_sub(day(), 7), F.date_sub(day(), 70))] == pytest.approx([0, 0.15, 1.0])
    assert f(score.timing_gate(F.lit("APPLY_NOW"), F.lit(True), F.lit(None).cast("boolean"))) == "CONSIDER"
    assert [f(score.tier_from_likelihood(F.lit(n))) for n in (40, 20, 10, 9)] == ["APPLY_NOW", "CONSIDER", "MONITOR", "SKIP"]
    assert f(score.deadline_fields(F.lit("2026-06-10"), F.lit("estimated_annual"), day())).deadline_note.startswith("≈ Urgent")
    assert f(score.format_amount(d(1000), d(5000))) == "$1,000 – $5,000"


def test_judgements_and_corrections(spark):
    df = spark.createDataFrame([("1", "Fall Grant Cycle", "NBA Foundation", "feed", 2.0, [], None, "unknown", None, None)], "id string, title string, funder string, source string, prescore double, flags array<string>, deadline_date date, deadline_kind string, amount_min decimal(18,2), amount_max decimal(18,2)")
    say = lambda s: spark.createDataFrame([("1", s)], "id string, reply string")
    good = '{"mission_alignment": 1.1, "competitive_fit": -0.1, "strategic_fit": 0.05, "corrected_deadline": "2026-07-01", "corrected_amount_max": 5000, "clean_title": "ab"}'
    r = score.judge(df, say(good)).first()
    assert (r.final_score, r.recommendation) == (3.05, "MONITOR")
    assert score.judge(df, say("not json")).first().final_score == 2.0
    c = score.apply_corrections(df, say(good)).first()
    assert (str(c.deadline_date), int(c.amount_max), c.title) == ("2026-07-01", 5000, "NBA Foundation — Fall Grant Cycle")
    bad = score.apply_corrections(df, say('{"corrected_deadline": "soon", "corrected_amount_max": 0}')).first()
    assert (bad.deadline_date, bad.amount_max, bad.deadline_kind) == (None, None, "unknown")
    kept = score.rescore(spark.createDataFrame([("1", "Geo:1.00 | Size:0.80 | DL:0.70 | Org:0.40 | Partner:0.30 | Align:0.10 | Fit:+0.10")], "id string, breakdown string"), spark.createDataFrame([("1", 0.6, -0.1)], "id string, mission_alignment double, competitive_fit double")).first()
    assert (kept.final_score, kept.recommendation) == (3.8, "APPLY_NOW")


def test_selection(spark):
    rows = [("a", "SKIP", 2.4, False, "https://x.org"), ("b", "SKIP", 2.4, True, ""), ("c", "SKIP", 2.5, False, ""), ("d", "SKIP", 2.0, False, "https://www.linkedin.com/x"), ("e", "SKIP", 2.1, None, None)]
    best, more = report.select_near_miss(spark.createDataFrame(rows, "page_id string, tier string, score double, near_miss_checked boolean, url string"), 1)
    assert [r.page_id for r in best.collect()] == ["a"] and more.first().remaining == 1
    rows = [("a", "MONITOR", 2.6, False, False, True, None), ("b", "APPLY_NOW", 4.0, False, False, False, None), ("c", "CONSIDER", 3.3, True, False, True, None), ("d", "CONSIDER", 3.3, True, True, False, dt.date(2026, 1, 1)), ("e", "SKIP", 1.0, False, False, True, None)]
    df = spark.createDataFrame(rows, "id string, recommendation string, final_score double, researched boolean, stale boolean, pinned boolean, scan_date date")
    assert [r.id for r in report.select_research(df, day(), 3, 2).collect()] == ["a", "d", "b"]


def test_health(spark):
    reg = spark.createDataFrame([("A", True, ["a1", "a2"]), ("B", True, ["b"]), ("C", False, ["c"]), ("D", True, ["d"])], "name string, enabled boolean, sources array<string>")
    st = spark.createDataFrame([("a1", True, None, 3, 1, 2), ("a2", False, "x", 0, 0, 0), ("b", True, None, 0, 0, 0), ("zz", True, None, 4, 0, 1)], "source string, ok boolean, error string, raw int, repeats int, queued int")
    past = spark.createDataFrame([("b", dt.datetime(2026, 1, 1), 3)], "source string, ran_at timestamp, fetched int")
    got = {r.name: (r.state, r.dropped) for r in report.run_report(st, reg, past).collect()}
    assert got == {"A": ("failed", False), "B": ("empty", True), "C": ("off", False), "D": ("missing", False), "zz": ("unregistered", False)}
    assert report.overall_state(report.run_report(st, reg, past)).first().state == "failed"


def test_cache_and_candidates(spark):
    now = F.lit("2026-06-01").cast("timestamp")
    df = spark.createDataFrame([("u", None, "rolling", None, None, "newsletter"), ("v", None, "rolling", None, 5.0, "rss"), ("w", None, None, None, None, "rss")], "url string, deadline_date date, deadline_kind string, amount_min double, amount_max double, type string")
    cache = spark.createDataFrame([("u", dt.date(2026, 9, 1), "fixed", None, 9.0, dt.datetime(2026, 5, 30)), ("v", dt.date(2026, 9, 1), "fixed", None, 9.0, dt.datetime(2026, 5, 30)), ("w", dt.date(2026, 9, 1), "fixed", None, 9.0, dt.datetime(2026, 5, 1))], "url string, deadline_date date, deadline_kind string, amount_min double, amount_max double, fetched_at timestamp")
    got = {r.url: (r.deadline_kind, r.amount_max) for r in merge.fill_from_cache(df, cache, 7, now).collect()}
    assert got == {"u": ("fixed", 9.0), "v": ("rolling", 5.0), "w": ("rolling", None)}
    base, new = spark.createDataFrame([("a", 1)], "url string, n int"), spark.createDataFrame([("a", 2), ("b", 3), ("b", 4), (None, 5)], "url string, n int")
    assert sorted(r.n for r in merge.merge_first_wins(base, new, "url", [F.col("n")]).collect()) == [1, 3]


def test_landing(spark, tmp_path):
    (tmp_path / "rss").mkdir()
    (tmp_path / "rss/a.xml").write_text("<rss><channel><title>Sea & Trust</title><item><title>Call <![CDATA[A & B]]></title><link>https://x.org/1</link><description>&lt;p&gt;Text&lt;/p&gt;</description></item><item><title>Two</title><link>https://x.org/2</link></item></channel></rss>")
    (tmp_path / "api").mkdir()
    (tmp_path / "api/a.json").write_text('{"data": [{"id": "7", "t": "Grant", "src": [{"name": "A"}, {"name": "B"}]}, {"id": "7", "t": "Grant", "src": []}]}')
    options = {"items": "data", "schema": "data array<struct<id:string,t:string,src:array<struct<name:string>>>>", "fields": {"id": "x.id", "title": "x.t", "funder": "array_join(transform(x.src, s -> s.name), ', ')", "url": "concat('https://api/', x.id)"}}
    registry = [{"name": "rss", "format": "rss", "path": "rss"}, {"name": "api", "format": "json", "path": "api", "options": options}, {"name": "gone", "format": "parquet", "path": "gone"}, {"name": "off", "format": "rss", "path": "rss", "enabled": False}]
    rows, status = landing.read_landing(spark, registry, str(tmp_path))
    assert {r.source: (r.ok, r.raw) for r in status.collect()} == {"rss": (True, 2), "api": (True, 1), "gone": (False, None)}
    got = {r.title: r for r in rows.collect()}
    assert got["Call A & B"].description == "Text" and got["Call A & B"].funder == "Sea & Trust" and got["Grant"].id == "7"
    assert rows.columns == landing.RECORD.fieldNames()
    blocked = spark.createDataFrame([("Sign in to see more",), ("A real page",)], "p string")
    assert [r[0] for r in blocked.select(landing.is_blocked(F.col("p"))).collect()] == [True, False]


def test_streams(spark, tmp_path, sf_dir):
    from oppflow.streaming import incremental

    posts = spark.createDataFrame([("s", f"p{k % 3}") for k in range(6)], "source_url string, post_text string")
    posts.write.parquet(str(tmp_path / "in"))
    args = (spark, str(tmp_path / "in"), posts.schema, str(tmp_path / "out"), str(tmp_path / "ck"))
    incremental.stream_new_posts(*args).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    posts.union(spark.createDataFrame([("s", "new")], posts.schema)).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.stream_new_posts(*args).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    rows = spark.createDataFrame([("1", 5), ("1", 6), ("2", 7)], "id string, n int")
    rows.write.parquet(str(tmp_path / "rec"))
    for extra in (None, [("2", 9), ("3", 1)]):
        if extra:
            spark.createDataFrame(extra, rows.schema).write.mode("append").parquet(str(tmp_path / "rec"))
        incremental.stream_scan(spark, str(tmp_path / "rec"), rows.schema, str(tmp_path / "scan"), lambda d: d).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "scan/records")).collect()) == ["1", "2", "3"]
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert incremental.source_arrivals(e, "ts", "event_type").agg(F.sum("n")).first()[0] == e.count()


def test_report_tables(spark, tmp_path):
    df = spark.createDataFrame([("a\tb", 3.0, "APPLY_NOW", ["x", "y"]), ("c", None, "SKIP", [])], "title string, final_score double, recommendation string, flags array<string>")
    out = report.ranked_export(df).collect()
    assert len(out) == 1 and out[0].title == "a b" and out[0].flags == "x, y"
    report.write_ranked(df, str(tmp_path / "tsv"))
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).count() == 1
    h = spark.createDataFrame([("a", 1, 3), ("a", 2, 0), ("b", 1, 0), ("b", 2, 0)], "source string, ran_at int, fetched int")
    assert {(r.source, r.ran_at) for r in report.run_delta(h).filter("dropped").collect()} == {("a", 2)}
    assert report.keep_last(h, 1).count() == 2
