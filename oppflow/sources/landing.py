"""Readers over a landing zone of fetched payloads, and the union of all sources.

A registry row names a source, its format and its path under the root. A source
that can't be read becomes a failed status row, and the others go on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oppflow.functions import keys
from oppflow.functions.text import html_to_text
from oppflow.shared import materialize

RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "source", "title", "description", "url", "funder", "type")]
    + [T.StructField("deadline_date", T.DateType()), T.StructField("deadline_kind", T.StringType())]
    + [T.StructField(n, T.DecimalType(18, 2)) for n in ("amount_min", "amount_max")]
    + [T.StructField("country", T.StringType()), T.StructField("themes", T.ArrayType(T.StringType())), T.StructField("fetched_at", T.TimestampType())]
)
STATUS = "source string, ok boolean, error string, raw long"
BLOCKED = r"(?i)authwall|sign in to (?:see|continue|view)|join linkedin|log in to continue|verify you are (?:a )?human|enable javascript and cookies|access denied"


def is_blocked(payload: Column) -> Column:
    """A login wall or another page that stands in for the real one."""
    return F.coalesce(payload, F.lit("")).rlike(BLOCKED)


def repair_xml(c: Column) -> Column:
    """Bare ampersands escaped."""
    return F.regexp_replace(c, r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)", "&amp;")


def as_records(df: DataFrame) -> DataFrame:
    """The record columns in order; missing ones are null, others are left out."""
    have = set(df.columns)
    return df.select([(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in RECORD.fields])


FEED_ITEM = "title string, link string, description string, _raw string"


def plain_xml(c: Column) -> Column:
    """XML without CDATA sections, their text escaped instead, and with bare ampersands escaped: tags within such text are text."""
    inner = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cut = F.split(F.coalesce(c, F.lit("")), r"<!\[CDATA\[|\]\]>", -1)
    return F.array_join(F.transform(cut, lambda x, k: F.when(k % 2 == 1, inner(x)).otherwise(repair_xml(x))), "")


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """``funder, title, link, description, broken`` of the items of RSS files: each item goes through Spark's XML parser.

    ``funder`` is the channel's title. An item that is no XML stays whole in ``broken``, without other values. A file is one
    row until its items are cut, so it must fit into a task.
    """
    files = spark.read.text(path, wholetext=True).select(plain_xml(F.col("value")).alias("xml"))
    cut = F.split("xml", r"(?i)</item\s*>", -1)
    items = F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), lambda x: F.concat(F.regexp_extract(x, r"(?is)<item\b.*$", 0), F.lit("</item>")))
    head = F.regexp_extract(F.regexp_replace("xml", r"(?is)<item\b.*$", ""), r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    rows = files.select(html_to_text(head).alias("funder"), F.explode(items).alias("item"))
    rows = rows.withColumn("x", F.from_xml("item", FEED_ITEM, {"rowTag": "item", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_raw"}))
    bad = F.col("x").isNull() | F.col("x._raw").isNotNull()
    return rows.select("funder", *[F.when(~bad, F.col(f"x.{c}")).alias(c) for c in ("title", "link", "description")], F.when(bad, F.col("item")).alias("broken"))


def read_feed_xml(spark: SparkSession, path: str, source: str, description_chars: int | None = None) -> DataFrame:
    """Items of RSS files, one record each, with the title of their channel as funder; broken items are left out.

    ``description_chars``: characters of a description that the output has, all of them unless given.
    """
    rows = feed_items(spark, path).filter("broken IS NULL")
    text = html_to_text(html_to_text(F.col("description")))
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = rows.select(F.lit(source).alias("source"), html_to_text(F.col("title")).alias("title"), (text if description_chars is None else F.left(text, F.lit(description_chars))).alias("description"), empty("link").alias("url"), "funder", F.lit("rss").alias("type"))
    return as_records(out.withColumn("id", keys.surrogate_id(F.col("url"), F.col("title"))))


def read_api_json(spark: SparkSession, path: str, source: str, items: str, fields: dict[str, str], schema: str, description_chars: int | None = None) -> DataFrame:
    """Items of JSON payloads: ``items`` names the array, ``fields`` maps record columns to SQL over an item ``x``; an item seen before is dropped.

    ``description_chars``: characters of a description that the output has, all of them unless given.
    """
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = raw.select(F.explode(items).alias("x")).select(F.lit(source).alias("source"), F.lit("api").alias("type"), *[F.expr(e).alias(n) for n, e in fields.items()])
    if "description" in fields:
        text = html_to_text(F.col("description"))
        rows = rows.withColumn("description", text if description_chars is None else F.left(text, F.lit(description_chars)))
    if "id" not in fields:
        rows = rows.withColumn("id", keys.surrogate_id(F.col("url"), F.col("title")))
    return as_records(rows.dropDuplicates(["id"]))


def union_all(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    """All rows of all sources; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else spark.createDataFrame([], RECORD)


def with_defaults(df: DataFrame, defaults: DataFrame) -> DataFrame:
    """Country, themes and amounts of a source where a row has none; ``defaults`` has one row per source."""
    cols = ["country", "themes", "amount_min", "amount_max"]
    d = defaults.select("source", *[F.col(c).alias(f"_{c}") for c in cols])
    out = df.join(F.broadcast(d), "source", "left")
    return out.select(*[F.coalesce(c, f"_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def with_standing(live: DataFrame, standing: DataFrame, only_if_empty: bool = False) -> DataFrame:
    """Live rows and standing rows; ``only_if_empty``: a source's standing rows only where it has no live ones."""
    more = standing.join(live.select("source").distinct(), "source", "left_anti") if only_if_empty else standing
    return live.unionByName(more, allowMissingColumns=True)


def read_landing(spark: SparkSession, registry: list[dict], root: str) -> tuple[DataFrame, DataFrame]:
    """Records of all enabled sources and one status row each.

    A registry entry: ``name``, ``format`` (parquet, json, csv, orc, rss or
    table of records), ``path`` under ``root``, ``enabled`` and, for json, more
    arguments of :func:`read_api_json` in ``options``. Each source is read once, into
    the shared folder; a value in any column that can't be read makes it a failed source.
    """
    parts, states = [], []
    for r in registry:
        if not r.get("enabled", True):
            continue
        name, path, kind = r["name"], f"{root.rstrip('/')}/{r['path']}", r["format"]
        try:
            if kind == "rss":
                df = read_feed_xml(spark, path, name)
            elif kind == "json" and "options" in r:
                df = read_api_json(spark, path, name, **r["options"])
            else:
                reader = spark.read.schema(RECORD) if kind in ("json", "csv") else spark.read
                df = as_records(reader.format(kind).options(**({"header": "true"} if kind == "csv" else {})).load(path))
                df = df.withColumn("source", F.coalesce("source", F.lit(name)))
            df = materialize(df, "landed")  # every column is read here, once
            n = df.count()
        except Exception as e:  # a source that can't be read is a status, not the end of the scan
            states.append((name, False, str(e).splitlines()[0][:300], None))
            continue
        parts.append(df)
        states.append((name, True, None, n))
    return union_all(spark, parts), spark.createDataFrame(states, STATUS)


def read_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pages (``path, payload``) that are real, and those that are blocked."""
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("payload"))
    return pages.filter(~is_blocked(F.col("payload"))), pages.filter(is_blocked(F.col("payload")))
