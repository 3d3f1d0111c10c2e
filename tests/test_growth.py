"""What grows with the tables: work once for each row, over all cores, and no more rows than are needed."""

import itertools
import math
import random

from pyspark.sql import functions as F

from oppflow.operators import extract, merge, resolve, segment
from oppflow.plans import announcements
from oppflow.shared import materialize

TEXTS = [
    (1, "feed", "Deadline: 5 March 2027, grants of $12,500 to $20,000", "2027-03-05", "fixed", 12500, 20000),
    (2, "portal", "apply by 3/4/2027, up to USD 1,500", "2027-04-03", "fixed", None, 1500),
    (3, "newsletter", "please apply by May 31 for the award of 2000", "2026-05-31", "fixed", None, None),
    (4, "feed", "on a rolling basis, 5 March 2027, prize: 900", None, "rolling", None, None),
    (5, "feed", "submit by May 31", None, "unknown", None, None),
    (6, "feed", "", None, "unknown", None, None),
    (7, "feed", None, None, "unknown", None, None),
]


def _plan(df) -> str:
    spark = df.sparkSession
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_fields_are_worked_out_once(spark):
    df = spark.createDataFrame([(*r[:3], "2026-05-01") for r in TEXTS], "id int, source string, text string, received string")
    found = extract.extract_fields(df, patterns=extract.pattern_table(spark), ref_date_col="received")
    got = {r.id: (str(r.deadline_date) if r.deadline_date else None, r.deadline_kind, r.amount_min, r.amount_max) for r in found.collect()}
    assert got == {r[0]: (*r[3:5], *r[5:]) for r in TEXTS}
    # a pattern of all sources stands once for each of the two sources named in the table and once for the others
    assert _plan(found).count("fecha\\s+l[ií]mite") == 3
    assert _plan(extract.extract_fields(df)).count("prize(?:\\s+pool)?") == 2  # one for each of its two groups


def test_announcements_are_dealt_over_all_cores(spark, sf_dir):
    assert announcements.notices(spark, sf_dir).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def _records(spark):
    rows = [(k, f"Grant {'water' if k % 5 else 'forest'} number{k:03d} place{k * 7 % 300:03d}", f"https://one.org/calls/c{k:03d}") for k in range(300)]
    rows += [(1000 + k, "The Same Title For All Of Them", f"https://h{k}.org/x") for k in range(20)] + [(2000 + k, f"Other number{2000 + k}", "https://two.org/" + ("a/b" if k else "")) for k in range(6)]
    return spark.createDataFrame(rows, "id long, title string, url string")


def test_records_of_a_host_with_other_paths_do_not_meet(spark):
    keyed = resolve.build_keys(_records(spark)).cache()
    blocks = resolve._blocks(keyed, keyed)
    sizes = blocks.groupBy("h").agg(F.sum(F.col("as_left").cast("long")).alias("l"), F.sum(F.col("as_right").cast("long")).alias("r"))
    assert sizes.agg(F.sum(F.col("l") * F.col("r"))).first()[0] < 10_000  # all pairs of the host alone: 90000


def test_pairs_are_found_once_in_tiles_and_never_moved(spark, monkeypatch):
    df = _records(spark)
    whole = resolve.match_pairs(df)
    want = sorted(map(tuple, whole.collect()))
    assert len(want) == len({x[:2] for x in want}) and sum(r in ("host", "url") for *_, r in want) == 15 and sum(r == "squash" for *_, r in want) == 190
    steps = [x.strip(" :+-") for x in _plan(whole).splitlines()]
    assert not any(x.startswith(("Aggregate", "Repartition", "Sort", "Window")) for x in steps[: next(k for k, x in enumerate(steps) if x.startswith("Join"))])
    monkeypatch.setattr(resolve, "BLOCK_ROWS", 3)
    monkeypatch.setattr(resolve, "TASK_PAIRS", 50)
    assert sorted(map(tuple, resolve.match_pairs(df).collect())) == want
    two = resolve.match_pairs(df.filter("id % 2 = 0"), df)
    assert {(r.id_a, r.id_b) for r in two.filter("id_a < id_b").collect()} == {x[:2] for x in want if x[0] % 2 == 0}


def _pair_steps(df) -> set[str]:
    """What is done to pairs, from the join that makes them up to the first step that keeps a row for each record."""
    steps = [x.strip(" :+-") for x in _plan(df).splitlines()]
    pairs = next(k for k, x in enumerate(steps) if x.startswith("Join Inner") and "array_intersect" in x)
    last = max(k for k in range(pairs) if steps[k].startswith("Aggregate"))
    return {x.split()[0] for x in steps[last:pairs]}


def test_records_that_match_nothing(spark):
    df = _records(spark)
    got = resolve.anti_match(df, df.filter("id IN (7, 1003, 2000)"))
    assert {r.id for r in got.select("id").collect()} == {k for k in range(300) if k != 7}
    assert _pair_steps(got) == {"Aggregate", "Project", "Generate"}  # no join and no shuffle of pairs in between


def test_actions_of_a_large_host(spark):
    src = _records(spark).select("*", F.lit("CONSIDER").alias("tier"), F.lit(2.0).alias("final_score"), F.lit("").alias("angle"), F.lit(False).alias("researched"), F.lit(False).alias("not_a_grant"))
    tgt = src.filter("id IN (7, 9, 1003, 2000)").select(F.col("id").alias("page_id"), "title", "url", "tier", F.col("final_score").alias("score"), "angle", "researched")
    got = merge.classify_upsert(src, tgt)
    # the identity key of the host is page 7's, which is another program than all others
    assert {r.id: (r.page_id, r.action) for r in got.collect() if r.action != "create"} == {7: (7, "unchanged"), 9: (9, "merge"), 1003: (1003, "unchanged")} | {1000 + k: (1003, "merge") for k in range(20) if k != 3} | {2000 + k: (2000, "unchanged") for k in range(6)}
    assert _pair_steps(got) == {"Aggregate", "Project", "Generate"}


def test_snapshot_of_a_large_host(spark):
    src = _records(spark).select("*", F.lit("CONSIDER").alias("tier"), F.lit(2.0).alias("final_score"), F.lit("").alias("angle"), F.lit(False).alias("researched"), F.lit(False).alias("not_a_grant"))
    tgt = src.filter("id IN (7, 9, 1003, 2000)").select(F.col("id").alias("page_id"), "title", "url", F.lit("SKIP").alias("tier"), F.col("final_score").alias("score"), "angle", "researched", F.lit("Seen").alias("status"), F.lit("1997-01-01").cast("date").alias("scan_date"))
    got = merge.upsert(src, tgt, F.lit("1997-06-01").cast("date"))[1]
    assert sorted((r.tier, r.status) for r in got.collect()) == [("CONSIDER", "New")] * 298 + [("CONSIDER", "Seen")] * 4
    assert _pair_steps(got) == {"Aggregate", "Project", "Generate"}


def test_words_of_titles_with_equal_letters_are_those_of_the_least_id(spark):
    rows = [(k, "Water Atat Atat" if k == 3 else "Wa Ter Atatatat" if k % 2 else "Water At At Atat", "") for k in range(20, 2, -1)]
    keyed = resolve.build_keys(spark.createDataFrame(rows, "id long, title string, url string").repartition(5))
    assert {r.word: r.n for r in resolve.word_frequency(keyed).collect()} == {"water": 1, "atat": 1}
    assert {r.word: r.n for r in resolve.word_frequency(keyed.filter("id > 4")).collect()} == {"atatatat": 1}


def test_lists_of_many_items_are_split_whole(spark):
    texts = [(n, "Open calls of the week: " + " ".join(f"➜ Grant {k} of the coast | $5000 | closes 3 May 2027" for k in range(n))) for n in (15, 16, 40)]
    got = segment.segment_posts(spark.createDataFrame(texts, "post_id long, post_text string"))
    assert {r.post_id: r.n for r in got.filter("segment > 0 AND kind = 'arrows'").groupBy("post_id").agg(F.count_distinct("title").alias("n")).collect()} == {15: 15, 16: 16, 40: 40}


def _vectors(spark, n, kind="float"):
    rng = random.Random(3)
    rows = [(f"v{k:03d}", [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(6)]) for k in range(n)]
    return rows, spark.createDataFrame(rows, f"id string, embedding array<{kind}>")


def test_tiles_of_vectors_are_not_shuffled_for_each_other(spark):
    rows, df = _vectors(spark, 60)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / max(math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 1e-300)
    want = {(a, b) for (a, u), (b, v) in itertools.combinations(rows, 2) if cos(u, v) >= 0.71}
    got = resolve.similar_vectors(df, threshold=0.71, tile_rows=7)
    assert sorted((r.id_a, r.id_b) for r in got.collect()) == sorted(want) and len(want) > 50
    assert "Exchange hash" not in got._jdf.queryExecution().executedPlan().toString()
    some = df.filter("id < 'v020'")
    two = resolve.similar_vectors(some, _vectors(spark, 60, "double")[1].filter("id >= 'v020'"), threshold=0.71, tile_rows=7)
    assert {(r.id_a, r.id_b) for r in two.collect()} == {x for x in want if x[0] < "v020" <= x[1]}
    assert resolve.similar_vectors(df.filter("false")).count() == 0


def test_pairs_of_records_without_a_mark_go_before_keys_travel(spark):
    rows = [(1, "Alpha Water Prize", "https://a.org/x/1", [1.0, 0.0]), (2, "Omega Forest Award", "https://a.org/y/2", [0.6, 0.8]), (3, "Challenge of Vaults movenow", "https://b.org/m/1", [0.0, 1.0]), (4, "Some Other Reef Call movenow", "https://c.org/n/2", [0.6, 0.8001])]
    df = spark.createDataFrame(rows, "id long, title string, url string, embedding array<double>")
    got = resolve.vector_candidates(df)
    seen = {(r.id_a, r.id_b): r.why for r in got.collect()}
    assert (1, 2) not in seen and seen[(3, 4)] == ["marker"]
    steps = [x.strip(" :+-") for x in _plan(got).splitlines()]
    slim = next(k for k, x in enumerate(steps) if x.startswith("Filter") and "has_mark" in x)
    joins = [k for k, x in enumerate(steps) if x.startswith("Join")]
    assert sum(k < slim for k in joins) == 2 and any(k > slim for k in joins)


def test_pairs_between_clusters_are_looked_at_once(spark):
    keyed = materialize(resolve.build_keys(_records(spark)), "keys")
    got = resolve.linked(keyed)
    assert {(r.id, r.root) for r in got.collect()} == {(1000 + k, 1000) for k in range(1, 20)} | {(2000 + k, 2000) for k in range(1, 6)}
    # the links are written: what comes after reads them and compares no records again
    assert "arrays_overlap" not in _plan(got)
