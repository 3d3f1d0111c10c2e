"""Identity: the truth table, blocked pairs against every pair, clusters, history, vectors."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from oppflow.functions import keys
from oppflow.functions.text import clean_title, fold, qualify_title
from oppflow.operators import history, merge, resolve

CASES = [
    ("Hispanic Impact Fund", "https://app.easygrant.io/lists/discover/01KSH1", "Global Innovation Challenge 2026", "https://app.easygrant.io/lists/discover/01KSH2", False),
    ("Youth4Climate Grants 2026", "https://youth4climate.org/apply", "Youth4Climate — How to Apply", "https://youth4climate.org/how-to-apply", True),
    ("Youth4Climate Grants 2026", "https://youth4climate.org/apply/2026", "Youth4Climate Grants 2027", "https://youth4climate.org/apply/2027", False),
    ("Youth Climate Justice Fund (YCJF) 2026", "https://ycjf.org", "Fondos de YCJF para impulsar la justicia", "https://gestionandote.org/x", True),
    ("Stanley 1913 Creators Fund", "https://app.easygrant.io/a", "Stanley 1913 Creators Fund – 2026 Program", "https://stanley1913.com/fund", True),
    ("Youth Climate Fund", "https://a.org/x", "Youth Climate Prize", "https://b.org/y", False),
    ("2027 Global Health Challenge", "https://solve.mit.edu/challenges/2027-global-health-challenge", "2027 Global Economic Prosperity Challenge", "https://solve.mit.edu/challenges/2027-global-economic-prosperity-challenge", False),
    ("GirlUp Project Awards", "https://x.org/1", "Girl Up Project Awards 2026", "https://y.org/2", True),
    ("UN Environment Programme Small Grants Programme", "https://p.org/1", "UNEP Small Grants Program 2026", "https://q.org/2", True),
    ("UN Environment Programme Small Grants Programme", "https://p.org/1", "UNEP Finance Initiative Membership", "https://q.org/2", False),
    ("Green Fund", "https://p.org/1", "GreenFund", "https://q.org/2", False),
    ("Social Shifters MoveNow Challenge 2026", "https://socialshifters.co/movenow", "Social Shifters Global Innovation Challenge 2026", "https://socialshifters.co/global", False),
    ("Relx Environmental Challenge 2025", "https://relx.com/corporate-responsibility/engaging-others/environmental-challenge", "RELX Environmental Challenge", "https://relx.com/news/archive", True),
    ("Japanese Award for Most Innovative Development Project (MIDP)", "https://www.gdn.int/gdac/2026/midp", "Japanese Award for Outstanding Research on Development (ORD)", "https://www.gdn.int/gdac/2026/ord", False),
    ("𝐌𝐈𝐓 𝐒𝐨𝐥𝐯𝐞 𝐆𝐥𝐨𝐛𝐚𝐥 𝐇𝐞𝐚𝐥𝐭𝐡 𝐂𝐡𝐚𝐥𝐥𝐞𝐧𝐠𝐞", "https://lnkd.in/a", "MIT Solve Global Health Challenge", "https://p.org/1", True),
    ("UNICEF Femtech Ventures", "https://p.org/1", "UNICEF Innovation Office Call", "https://q.org/2", False),
    ("CONVOCATORIA PARA JÓVENES RURALES DEL NORTE", "https://p.org/1", "CONVOCATORIA PARA MUJERES LIDERES DEL SUR", "https://q.org/2", False),
    ("A Name", "https://bit.ly/abc", "Another Name", "https://bit.ly/abc", False),
    ("A Name", "https://funder.org/call", "Another Name", "https://www.funder.org/call/", True),
]


def pairs_df(spark):
    rows = []
    for k, (a, ua, b, ub, _) in enumerate(CASES):
        rows += [(2 * k, a, ua), (2 * k + 1, b, ub)]
    return spark.createDataFrame(rows, "id long, title string, url string")


def test_truth_table(spark):
    got = {(r.id_a, r.id_b): r.rule for r in resolve.match_pairs(pairs_df(spark)).collect()}
    wrong = [(a, b, got.get((2 * k, 2 * k + 1))) for k, (a, _, b, _, want) in enumerate(CASES) if want != ((2 * k, 2 * k + 1) in got)]
    assert wrong == []


def test_blocking_loses_no_pair(spark):
    rng = random.Random(11)
    words = ["climate", "youth", "water", "forest", "energy", "women", "MIDP", "YCJF", "UNEP", "2026", "2027", "un environment programme", "fund", "the", "movenow", "greenhouse", "resilience"]
    hosts = ["a.org", "b.org", "bit.ly", "linkedin.com", "devex.com", "www.c.org"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))), rng.choice([None, "", f"https://{rng.choice(hosts)}/{rng.choice(['', 'x', 'x/y', 'x/z', 'p/2026/q'])}"])) for k in range(140)]
    df = spark.createDataFrame(rows, "id long, title string, url string")
    k = resolve.build_keys(df).cache()
    a, b = k.select(F.col("id").alias("id_a"), F.col("k").alias("a")), k.select(F.col("id").alias("id_b"), F.col("k").alias("b"))
    every = {(r.id_a, r.id_b) for r in a.join(b, F.col("id_a") < F.col("id_b")).filter(resolve.rule_of(F.col("a"), F.col("b")).isNotNull()).select("id_a", "id_b").collect()}
    got = {(r.id_a, r.id_b) for r in resolve.match_pairs(df).collect()}
    assert got == every and len(every) > 100
    left, right = df.filter("id < 70"), df.filter("id >= 70")
    two = {(r.id_a, r.id_b) for r in resolve.match_pairs(left, right).collect()}
    assert two == {(x, y) for x, y in every if x < 70 <= y}


def test_fingerprints(spark):
    rows = [("Anything 2026", "https://www.funder.org/x"), ("Anything 2026", "https://bit.ly/q"), ("Blue Ocean Youth Award 2026", "https://lnkd.in/z"), ("", "")]
    df = spark.createDataFrame(rows, "title string, url string")
    assert [r.f for r in df.select(keys.fingerprint(F.col("title"), F.col("url")).alias("f")).collect()] == ["funder.org||2026", "bit.ly||2026", "|anything-blue"[:1] + "blue-ocean-youth|2026", ""]


def test_dedupe_keeps_the_richest(spark):
    rows = [(1, "Blue Ocean Youth Resilience", "", None, ""), (2, "Blue Ocean Youth Resilience", "https://x.org/a", 5.0, "a long enough description"), (3, "Other Thing Entirely Here", "https://y.org", None, "")]
    df = spark.createDataFrame(rows, "id long, title string, url string, amount_max double, description string")
    for mode in ("components", "star"):
        got = {r.id: (r.cluster, r.cluster_size) for r in resolve.dedupe(df, mode).collect()}
        assert got == {2: (1, 2), 3: (3, 1)}
    assert resolve.dedupe(df.filter("false")).count() == 0


def test_seen_by_id_and_fingerprint(spark):
    now = "timestamp'2026-01-01'"
    seen = spark.sql(f"SELECT 'a' AS id, 'Old Call' AS title, 'https://funder.org/p/one' AS url, {now} AS first_seen")
    fps = spark.sql(f"SELECT 'funder.org||' AS fingerprint, 'a' AS record_id, 'Old Call' AS title, {now} AS first_seen")
    rows = [("a", "Anything", "https://z.org"), ("b", "Old Call Again", "https://funder.org/p/one"), ("c", "Quite Different Matter", "https://funder.org/q/two"), ("d", "New", "https://new.org")]
    df = spark.createDataFrame(rows, "id string, title string, url string")
    new, repeats = history.split_seen(df, seen, fps)
    assert {r.id for r in new.collect()} == {"c", "d"}
    assert {r.id: r.via for r in repeats.collect()} == {"a": "same id", "b": "same fingerprint"}
    assert new.columns == df.columns
    ids, more = history.mark_seen(new, F.lit("2026-02-01").cast("timestamp"))
    assert ids.count() == 2 and {r.fingerprint for r in more.collect()} == {"funder.org||", "new.org||"}


def test_posts_twice(spark):
    posts = spark.createDataFrame([("s", f"post {k}") for k in range(8)] + [("s", "Post  1")], "source_url string, post_text string")
    none = spark.createDataFrame([], "fingerprint string")
    new, all_ = history.split_seen_posts(posts, none)
    assert new.count() == 8 and all_.count() == 8
    again, _ = history.split_seen_posts(posts, all_)
    assert again.count() == 0


def test_vector_candidates(spark):
    e = lambda *v: [float(x) for x in v]
    rows = [(1, "Blue Ocean Youth Resilience Window", "https://lnkd.in/1", e(1, 0, 0)), (2, "Oceanic Resilience Round", "https://lnkd.in/2", e(0.99, 0.05, 0)), (3, "Grant", "https://lnkd.in/3", e(0, 1, 0)), (4, "Award", "https://lnkd.in/4", e(0, 1, 0.01)), (5, "x", None, [float("nan"), 0.0, 0.0]), (6, "y", None, []), (7, "z", None, e(1, 2))]
    df = spark.createDataFrame(rows, "id long, title string, url string, embedding array<double>")
    for exact in (True, False):
        got = {(r.id_a, r.id_b): r.why for r in resolve.vector_candidates(df, exact=exact).collect()}
        assert got == {(1, 2): ["near-identical"]}
    assert {(r.id_a, r.id_b) for r in resolve.similar_vectors(df, tile_rows=2).collect()} == {(1, 2), (3, 4)}


def test_titles(spark):
    rows = [("Fall Grant Cycle", "NBA Foundation", "feed"), ("Blue Ocean Youth Award", "NBA Foundation", "feed"), ("Fall Grant Cycle", "Feed News", "feed news"), ("Fall Grant Cycle", "A, B and C", "feed")]
    df = spark.createDataFrame(rows, "t string, f string, s string")
    assert [r[0] for r in df.select(qualify_title(F.col("t"), F.col("f"), F.col("s"))).collect()] == ["NBA Foundation — Fall Grant Cycle", "Blue Ocean Youth Award", "Fall Grant Cycle", "Fall Grant Cycle"]
    df = spark.createDataFrame([("Itâ€™s  a​ test ",), ("𝐌𝐈𝐓",), (None,)], "t string")
    assert [r[0] for r in df.select(clean_title(F.col("t"))).collect()] == ["It's a test", "MIT", ""]
    assert [r[0] for r in df.select(fold(F.col("t"))).collect()][1:] == ["MIT", ""]


def test_upsert(spark):
    src = spark.createDataFrame(
        [("1", "Blue Fund", "https://blue.org/a", "CONSIDER", 3.3, "x", False, False), ("2", "Red Ocean Youth Resilience", "https://lnkd.in/r", "MONITOR", 2.6, "", False, False), ("3", "New One", "https://new.org", "SKIP", 1.0, "", False, False), ("4", "Junk", "https://junk.org", "SKIP", 1.0, "", False, True), ("5", "Same Fund", "https://same.org", "SKIP", 1.01, "", False, False)],
        "id string, title string, url string, tier string, final_score double, angle string, researched boolean, not_a_grant boolean",
    )
    tgt = spark.createDataFrame(
        [("p1", "Blue Fund", "https://blue.org/a", "MONITOR", 2.8, "x", False, "Applied", None), ("p2", "Red Ocean Youth Resilience", "https://red.org/x", "MONITOR", 2.6, "", False, "New", None), ("p5", "Same Fund", "https://same.org", "SKIP", 1.0, "", False, "New", None)],
        "page_id string, title string, url string, tier string, score double, angle string, researched boolean, status string, scan_date date",
    )
    acted, snap = merge.upsert(src, tgt, F.lit("2026-01-05").cast("date"))
    assert {r.id: (r.action, r.page_id) for r in acted.collect()} == {"1": ("update", "p1"), "2": ("merge", "p2"), "3": ("create", None), "4": ("not_a_grant", None), "5": ("unchanged", "p5")}
    rows = {r.title: r for r in snap.collect()}
    assert len(rows) == 4 and rows["Blue Fund"].status == "Applied" and rows["Blue Fund"].tier == "CONSIDER" and rows["New One"].status == "New" and rows["Same Fund"].score == 1.0


@pytest.mark.parametrize("n", [3, 60])
def test_components(spark, n):
    from oppflow.operators.graph import components

    edges = list(itertools.pairwise(range(n)))
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, n)}
