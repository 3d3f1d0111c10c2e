"""Feeds through the XML reader, whole descriptions, sources that break late."""

from oppflow.sources import landing

FEED = """<?xml version="1.0"?><rss version="2.0"><channel><title>Funds &amp; News</title><link>https://feed.example</link>
<item><title>Plain call</title><link>https://a.example/1</link><description>&lt;p&gt;Long {long}&lt;/p&gt; ends</description></item>
<item><title><![CDATA[Call with </item> in it]]></title><link>https://a.example/2</link><description><![CDATA[<b>Bold</b> text]]></description></item>
<item><title>Seeds & Roots</title><link>https://a.example/3?x=1&y=2</link><description>bare & signs</description></item>
<item><title>Broken <b>item</title><link>https://a.example/4</link></item>
<item><link>https://a.example/5</link></item>
</channel></rss>"""


def test_items_of_a_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(FEED.format(long="word " * 400))
    path = str(tmp_path / "feed.xml")
    rows = {r.url: r for r in landing.read_feed_xml(spark, path, "feed").collect()}
    assert {u: r.title for u, r in rows.items()} == {"https://a.example/1": "Plain call", "https://a.example/2": "Call with in it", "https://a.example/3?x=1&y=2": "Seeds & Roots", "https://a.example/5": ""}  # titles are text, without tags
    assert rows["https://a.example/1"].description.endswith("ends") and len(rows["https://a.example/1"].description) > 2000
    assert {r.funder for r in rows.values()} == {"Funds & News"} and rows["https://a.example/2"].description == "Bold text"
    assert [r.broken is not None and "Broken" in r.broken for r in landing.feed_items(spark, path).filter("broken IS NOT NULL").collect()] == [True]
    assert max(len(r.description or "") for r in landing.read_feed_xml(spark, path, "feed", description_chars=50).collect()) == 50


def test_a_source_that_breaks_late_is_a_failed_one(spark, tmp_path):
    spark.range(3).selectExpr("cast(id AS string) AS id", "'t' AS title", "array(1) AS url").write.parquet(str(tmp_path / "good.parquet"))
    spark.range(3).selectExpr("cast(id AS string) AS id", "'t' AS title", "map('a', id) AS deadline_date").write.parquet(str(tmp_path / "bad.parquet"))
    registry = [{"name": "bad", "format": "parquet", "path": "bad.parquet"}, {"name": "none", "format": "json", "path": "none.json"}, {"name": "off", "format": "csv", "path": "x", "enabled": False}]
    rows, status = landing.read_landing(spark, registry, str(tmp_path))
    assert {r.source: (r.ok, r.raw) for r in status.collect()} == {"bad": (False, None), "none": (False, None)} and rows.count() == 0
