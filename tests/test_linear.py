"""Texts of a megabyte that almost match: every scanner enters a run of characters once."""

import time

import pytest
from pyspark.sql import functions as F

from oppflow.functions.text import html_to_text
from oppflow.operators import extract, rules, segment

N = 1_000_000
LETTERS, LINES, OPEN = "A" * N, "\n" * N, "[" * N
COLUMNS = {
    "names of one run": (extract.mentioned_orgs, LETTERS),
    "names of many words": (extract.mentioned_orgs, "Green " * (N // 6)),
    "titles of one run": (extract.derive_title, LETTERS),
    "titles of many words": (extract.derive_title, "Green " * (N // 6)),
    "item titles": (extract.derive_segment_title, "Green " * (N // 6)),
    "open brackets": (extract.markdown_parts, OPEN),
    "open images": (extract.markdown_parts, "![" * (N // 2)),
    "links that never end": (extract.markdown_parts, "[a](http://" * (N // 11)),
    "digits and commas": (extract.markdown_parts, "1," * (N // 2)),
    "open tags": (html_to_text, "<" * N),
    "script that never ends": (html_to_text, "<script " * (N // 8)),
    "style that never ends": (html_to_text, "<style " * (N // 7)),
    "line ends before controls": (extract.strip_boilerplate, LINES + "x"),
    "blank lines": (segment.without_footer, "a" + "\n \n" * (N // 3) + "b"),
    "lines of hashtags": (segment.without_footer, "a" + "\n#tag #tag" * (N // 10) + " b"),
    "numbers of a list": (segment.looks_like_record, "1,1." * (N // 4)),
    "marks": (lambda c: segment.list_marks(c, F.lit(True)), "1. A 3. B " * (N // 10)),
    "twice the same": (extract.split_title_funder, "ab" * (N // 2)),
    "relevance": (rules.is_relevant, LINES),
}


@pytest.mark.parametrize("name", COLUMNS)
def test_a_megabyte_takes_seconds(spark, name):
    column, text = COLUMNS[name]
    df = spark.createDataFrame([("warm up",)], "t string")
    df.select(column(F.col("t"))).collect()
    one = spark.range(1).select(F.lit(text).alias("t")).repartition(1)  # not worked out by the optimizer
    began = time.time()
    one.select(column(F.col("t")).alias("c")).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 20  # a scan that starts anew at every character takes hours


@pytest.mark.parametrize("html", ["<a " * (N // 3), '<a href="x">' * (N // 12), "<" * N])
def test_links_of_a_long_page(spark, html):
    page = spark.range(1).select(F.col("id").alias("page_id"), F.lit(html).alias("html")).repartition(1)
    segment.page_links(page.withColumn("html", F.lit("<a href='x'>"))).count()
    began = time.time()
    assert segment.page_links(page).count() == 0
    assert time.time() - began < 20


def test_bracketed_letters_with_long_gaps(spark):
    body = "[Region] Fund: Call: text" + "\n" * N + "x"
    regions = spark.createDataFrame([("Region", "C")], "region string, country string")
    message = spark.range(1).select(F.col("id").alias("message_id"), F.lit(body).alias("body")).repartition(1)
    began = time.time()
    assert segment.segment_bracketed(message, regions).count() == 1
    assert time.time() - began < 20
