"""Queries over announcements made from the given orders, lines and parts, and their DuckDB SQL: lists, dates, rule tables.

The texts are written by Spark from the tables, so what they say is known: the SQL reads it from the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oppflow.functions import fixed
from oppflow.operators import extract, rules, segment
from oppflow.plans.queries import query
from oppflow.shared import spread, table

_LINES = """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n, count(*) OVER (PARTITION BY l_orderkey) AS k,
 'Grant ' || l_partkey || ' – supplier ' || l_suppkey AS name, l_quantity::INT AS q, l_shipdate FROM lineitem"""


def roundups(spark, sf_dir) -> DataFrame:
    """``post_id, post_text``: a post of one line for each order, a list of its lines: numbered, with arrows or with check marks."""
    line = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey")
    line = line.withColumns({"n": F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")), "k": F.count("*").over(w)})
    kind = F.col("l_orderkey") % 3
    mark = F.when(F.col("k") == 1, "").when(kind == 0, F.concat("n", F.lit(". "))).when(kind == 1, "➜ ").otherwise("✅ ")
    said = F.concat(mark, F.lit("Grant "), F.col("l_partkey").cast("string"), F.lit(" – supplier "), F.col("l_suppkey").cast("string"), F.lit(" | $"), F.col("l_quantity").cast("int").cast("string"), F.lit("000 | closes "), F.date_format("l_shipdate", "d MMMM yyyy"))
    posts = line.select("l_orderkey", F.struct("n", said.alias("t")).alias("i")).groupBy(F.col("l_orderkey").alias("post_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda x: x["t"]), " ").alias("t"))
    return posts.select("post_id", F.concat(F.lit("Open calls of the week: "), "t", F.lit(" Follow us for more #calls")).alias("post_text"))


@query(
    f"""WITH l AS ({_LINES}), i AS (SELECT *, name || ' | $' || q || '000 | closes ' || strftime(l_shipdate, '%-d %B %Y') AS t FROM l)
SELECT l_orderkey AS post_id, n::INT AS segment, t AS text, name AS title, ['numbers', 'arrows', 'bullets'][(l_orderkey % 3 + 1)::INT] AS kind, 'Open calls of the week:' AS header FROM i WHERE k > 1
UNION ALL SELECT l_orderkey, 0, 'Open calls of the week: ' || t || ' Follow us for more #calls', 'Open calls of the week: ' || name, NULL, '' FROM i WHERE k = 1"""
)
def list_posts(spark, sf_dir):
    """Posts of one line as one row for each item of their lists."""
    return segment.segment_posts(roundups(spark, sf_dir)).drop("start", "end")


def notices(spark, sf_dir) -> DataFrame:
    """``id, source, text, received``: an announcement for each order, whose date is written in one of six ways."""
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    es = F.get(F.array(*map(F.lit, fixed.MONTHS_ES)), F.month(day) - 1)
    ways = [
        ("feed", F.concat(F.lit("Deadline: "), F.date_format(day, "d MMMM yyyy"))),
        ("feed", F.concat(F.lit("closes "), F.date_format(day, "MMMM d, yyyy"))),
        ("feed", F.concat(F.lit("Fecha límite: "), F.dayofmonth(day).cast("string"), F.lit(" de "), es, F.lit(" de "), F.year(day).cast("string"))),
        ("portal", F.date_format(day, "d/M/yyyy")),
        ("feed", F.date_format(day, "M/d/yyyy")),
        ("newsletter", F.concat(F.lit("please apply by "), F.date_format(day, "MMMM d"))),
    ]
    pick = lambda n: F.get(F.array(*[F.lit(w[0]) if n == 0 else w[1] for w in ways]), (k % 6).cast("int"))
    money = F.concat(F.get(F.array(F.lit("A$ "), F.lit("USD "), F.lit("EUR ")), (k % 3).cast("int")), F.floor("o_totalprice").cast("string"))
    text = F.concat(F.lit("A call for all: up to "), money, F.lit(". "), pick(1), F.when(k % 7 == 0, ", on a rolling basis").otherwise(""), F.lit("."))
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select(k.alias("id"), pick(0).alias("source"), text.alias("text"), F.date_sub(day, 20).alias("received"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS deadline_date, CASE WHEN o_orderkey % 7 = 0 THEN 'rolling' ELSE 'fixed' END AS deadline_kind,
 CASE WHEN a >= 1000 AND a NOT BETWEEN 1900 AND 2100 THEN a END::DECIMAL(18,2) AS amount_max, CASE WHEN a >= 1000 AND a NOT BETWEEN 1900 AND 2100 THEN ['AUD', 'USD', 'EUR'][(o_orderkey % 3 + 1)::INT] END AS currency
FROM (SELECT *, floor(o_totalprice)::BIGINT AS a FROM orders)"""
)
def dates_by_pattern(spark, sf_dir):
    """Dates by the pattern table: named months of two languages, days first by source, years from the message."""
    found = extract.extract_fields(notices(spark, sf_dir), patterns=extract.pattern_table(spark), ref_date_col="received")
    return found.select("id", "deadline_date", "deadline_kind", "amount_max", "currency")


#: (priority, name, pattern, weight) and (priority, source, pattern, mission, competitive), over words of parts.
_BOOK = [(1, "ring", r"\bring\b", 0.9), (2, "colour", "red|blue|green", 0.6), (3, "small tool", r"small\s+(?:bolt|gear|widget)", 0.7), (4, "any of e", "e.*e", 0.3), (5, "never", "no such word (?:at all)+", 1.0), (6, "hot", "^HOT", 0.5)]
_SOURCES = [(1, "ECONOMY", r"\bring\b", 0.9, 0.1), (2, None, "red|blue", 0.5, 0.0), (3, "PROMO", "g", 0.8, -0.2), (4, None, "bolt|gear", 0.4, 0.2)]
_VALUES = ", ".join(f"({p}, '{n}', '{r}', {w})" for p, n, r, w in _BOOK)
_BY_SOURCE = ", ".join("({}, {}, '{}', {}, {})".format(p, "NULL" if s is None else f"'{s}'", r, m, c) for p, s, r, m, c in _SOURCES)


@query(
    f"""WITH r(priority, name, pattern, weight) AS (VALUES {_VALUES}), h AS (SELECT p_partkey, name, weight FROM part JOIN r ON regexp_matches(p_name, '(?i)' || pattern))
SELECT p.p_partkey AS id, coalesce(max(weight), 0.2)::DOUBLE AS rule_score, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS names FROM part p LEFT JOIN h USING (p_partkey) GROUP BY 1"""
)
def scored_by_rule_book(spark, sf_dir):
    """Each part's score and rules from a table of patterns."""
    book = spark.createDataFrame(_BOOK, "priority int, name string, pattern string, weight double")
    parts = spread(table(spark, sf_dir, "part"), "p_partkey").withColumnRenamed("p_partkey", "id")
    return rules.rule_table_score(parts, book, F.col("p_name")).select("id", "rule_score", F.array_join("rule_names", ",").alias("names"))


@query(
    f"""WITH r(priority, source, pattern, mission, competitive) AS (VALUES {_BY_SOURCE}),
h AS (SELECT p_partkey, arg_min(mission, priority) AS mission, arg_min(competitive, priority) AS competitive FROM part JOIN r ON (source IS NULL OR source = p_type) AND regexp_matches(p_name || ' ' || p_brand, '(?i)' || pattern) GROUP BY 1)
SELECT p.p_partkey AS id, coalesce(mission, 0.1)::DOUBLE AS mission_alignment, round(coalesce(competitive, -0.1) - CASE WHEN regexp_matches(p_name, '(?i)widget') THEN 0.4 ELSE 0 END, 2)::DOUBLE AS competitive_fit FROM part p LEFT JOIN h USING (p_partkey)"""
)
def scored_by_source(spark, sf_dir):
    """C11: the first rule of each part's source, less a penalty."""
    book = spark.createDataFrame(_SOURCES, "priority int, source string, pattern string, mission double, competitive double")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("description"), F.col("p_type").alias("source"))
    return rules.source_rules(parts, book, {"widget": -0.4}).select("id", "mission_alignment", "competitive_fit")
