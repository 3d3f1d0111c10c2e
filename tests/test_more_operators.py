"""Operators that the other modules do not reach."""

import datetime as dt

from pyspark.sql import functions as F

from oppflow.operators import merge, report, rules, score, segment
from oppflow.sources import landing

DAY = dt.date(2026, 6, 1)


def test_prompts(spark):
    df = spark.createDataFrame([("1", "A call", "x" * 900, None)], "id string, title string, description string, funder string")
    got = score.prompt_table(df, "T={title} F={funder} D={description}").first().prompt
    assert got == "T=A call F=unknown D=" + "x" * 800


def test_catalogue_rows_as_candidates(spark):
    snap = spark.createDataFrame(
        [("p1", "Old", "https://o.org", "MONITOR", 2.6, "Up to $5,000", "s", "n", DAY, True), ("p2", "Known", "https://k.org", "MONITOR", 2.6, None, "s", "n", DAY, False), ("p3", "Low", "https://l.org", "SKIP", 1.0, None, "s", "n", DAY, False)],
        "page_id string, title string, url string, tier string, score double, amount_text string, summary string, notes string, scan_date date, pinned boolean",
    )
    fresh = spark.createDataFrame([(1, "Known", "https://k.org")], "id int, title string, url string")
    got = {r.title: r for r in merge.catalogue_candidates(snap, fresh, ["MONITOR"]).collect()}
    assert set(got) == {"Known", "Old"} and int(got["Old"].amount_max) == 5000 and got["Old"].description == "s\nn"


def test_match_with_fallback(spark):
    text = "A rather long caption about a grant for water projects in rural towns"
    left = spark.createDataFrame([("1", text), (None, text + "!"), ("9", "short")], "activity string, caption string")
    right = spark.createDataFrame([("1", text, "img1"), ("7", "tiny", "img2")], "activity string, caption string, img string")
    got = {(r.activity, r.found.img if r.found else None) for r in segment.match_with_fallback(left, right, "activity", "caption").collect()}
    assert got == {("1", "img1"), (None, "img1"), ("9", None)}


def test_repeat_audit(spark):
    ids = spark.createDataFrame([(k,) for k in range(5)], "id long")
    one = lambda *x: spark.createDataFrame([(k,) for k in x], "id long")
    pairs = spark.createDataFrame([(0, 1)], "id_a long, id_b long")
    got = {r.id: r.state for r in report.repeat_audit(ids, pairs, one(1, 2), one(2, 3)).collect()}
    assert got == {0: "new", 1: "repeat in run", 2: "known", 3: "in catalogue", 4: "new"}


def test_media(spark):
    good = "https://media.x.com/dms/image/a"
    rows = [(1, 0, good, 300, 300), (1, 1, good, 300, 300), (1, 2, good + "logo", 300, 300), (1, 3, good + "b", 100, 300), *[(2, k, f"{good}{k}", 300, 300) for k in range(6)]]
    got = segment.media_rows(spark.createDataFrame(rows, "post_id long, pos int, url string, width int, height int")).groupBy("post_id").count().collect()
    assert {r.post_id: r["count"] for r in got} == {1: 1, 2: 4}
    rec = spark.createDataFrame([(1, None, None, True, "x" * 200), (2, DAY, None, True, "x" * 200), (3, DAY, 5.0, False, "short")], "post_id long, deadline_date date, amount_max double, url_is_fallback boolean, description string")
    assert {r.post_id for r in segment.needs_media(rec).collect()} == {1, 3}
    posts, texts = spark.createDataFrame([(1, "a"), (2, "b")], "post_id long, post_text string"), spark.createDataFrame([(1, "t2"), (1, "t1")], "post_id long, text string")
    assert {r.post_id: r.post_text for r in segment.append_text(posts, texts).collect()} == {1: "a\n\nt1\nt2", 2: "b"}


def test_posts_as_records(spark):
    link = "struct<label:string,url:string,junk:string>"
    rows = [("1", "src", "T", "3 funds for you", [("A long label", "https://a.org", None), ("B", "https://b.org", None)], "https://p.org", "https://s.org", ["x"], None), ("2", "src", "T", "one", [("A", "https://a.org", "login")], "https://p.org", "https://s.org", [], None)]
    df = spark.createDataFrame(rows, f"post_id string, source_name string, title string, post_text string, links array<{link}>, post_url string, source_url string, hashtags array<string>, detected_at timestamp")
    assert [r.title for r in segment.split_multi_link(df).orderBy("n").collect()] == ["A long label", "T (2/2)"]
    assert {r.id: (r.url, r.url_is_fallback) for r in segment.post_to_record(df).collect()} == {"1": ("https://a.org", False), "2": ("https://p.org", True)}


def test_source_rules_and_second_pass(spark):
    df = spark.createDataFrame([("1", "a", "Marine grant", "x"), ("2", "b", "Plain", "agrifood")], "id string, source string, title string, description string")
    table = spark.createDataFrame([(2, None, "grant", 0.5, 0.0), (1, "a", "marine", 0.9, 0.0)], "priority int, source string, pattern string, mission double, competitive double")
    got = {r.id: (r.mission_alignment, r.competitive_fit) for r in rules.source_rules(df, table, {"marine": -0.4, "agrifood": -0.4}).collect()}
    assert got == {"1": (0.9, -0.4), "2": (0.1, -0.5)}
    df = spark.createDataFrame([("We are hiring a consultant",), ("Upcoming:",), ("Real call",), ("MBA degree",)], "title string")
    assert [r[0] for r in df.select(rules.first_rule(rules.SECOND_PASS)).collect()] == ["JOB_POST", "SECTION_HEADER", None, "COURSE_NOT_GRANT"]


def test_defaults_and_standing(spark):
    rows = spark.createDataFrame([("a", None, 5.0), ("b", "X", None)], "source string, country string, amount_max double").withColumn("themes", F.lit(None).cast("array<string>")).withColumn("amount_min", F.lit(None).cast("double"))
    d = spark.createDataFrame([("a", "LAC", ["t"], 1.0, 2.0), ("b", "LAC", ["t"], 1.0, 2.0)], "source string, country string, themes array<string>, amount_min double, amount_max double")
    assert {r.source: (r.country, r.amount_max, r.themes) for r in landing.with_defaults(rows, d).collect()} == {"a": ("LAC", 5.0, ["t"]), "b": ("X", 2.0, ["t"])}
    live, stand = spark.createDataFrame([("a", 1)], "source string, n int"), spark.createDataFrame([("a", 2), ("c", 3)], "source string, n int")
    assert sorted(r.n for r in landing.with_standing(live, stand, True).collect()) == [1, 3]
    assert landing.union_all(spark, []).count() == 0
