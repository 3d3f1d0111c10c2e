"""Filter interaction audit: what each filter removes, in every order in which filters may be applied.

One id table is stored per filter, with the rows that fail it. Joins over ids
alone do the rest; texts are read once, for the failure conditions:

* survivors: for each filter in turn every (prefix, row) is taken on with the
  filter added to its prefix, and a left-anti join with the filter's id table
  leaves those that pass. After the last filter the relation holds the
  survivors of every set of filters, whatever its order;
* removals: failing rows, for each prefix without their filter, that a
  left-semi join finds among the survivors of the prefix;
* redundancies: those that a left-anti join does not find there, so an earlier
  filter removed them;
* label losses: the labels of the removed rows.

An order of k filters is a path through these 2^k sets, so the counts of all
orders come from one small table of (part, set, filter).

Defined results: null text is empty, a null part the empty string; every row is
a document of its own, repeated rows too; of equal texts those with a larger id
than the smallest fail ``repeats`` (null ids count as largest and do not fail
against each other); several labels of an id count as one that has each value
that occurs, rows without an id have no label; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oppflow.operators.joins import salted_join
from oppflow.shared import materialize

SPACE = r"[\x20\x09-\x0D]+"
#: Rows of one text, at least, from which on its join is dealt over several tasks.
HOT_ROWS = 50_000


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions of single texts: A few words, B repetitive words, C many capitals, D markup signs."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 100,
        "B": 100 * distinct < 80 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def repeats(rows: DataFrame) -> DataFrame:
    """``row_id`` of the rows whose text (known by ``digest``) a row with a smaller ``id`` has too."""
    of = materialize(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1"), "texts")
    total = of.agg(F.sum("n")).first()[0] or 0
    several = rows.join(of.select("digest"), "digest", "left_semi") if total < HOT_ROWS else rows
    met = salted_join(several, of.select("digest", "first"), "digest", F.col("row_id"), total, HOT_ROWS, of.select("digest", "n"))
    return met.filter((F.col("id") > F.col("first")) | (F.col("id").isNull() & F.col("first").isNotNull())).select("row_id")


def judged_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", fails=conditions) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``row_id, part, good, toxic`` of every document, and for each filter the stored table of the ``row_id`` that fail it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    checks = fails(text)
    src = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), *[c.alias(f"fails_{f}") for f, c in checks.items()])
    read = materialize(src, "read")
    marked = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    rows = materialize(read.select("row_id", "id", "part").join(marked, "id", "left").select("row_id", "part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")), "rows")
    tables = {f: materialize(read.filter(f"fails_{f}").select("row_id"), f"fails-{f}") for f in checks}
    return rows, tables | {"E": materialize(repeats(read.select("row_id", "id", "digest")), "fails-E")}


def survivors(rows: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """``row_id, part, prefix``: the rows that pass all filters of a prefix, for every set of filters (bit k: the k-th filter)."""
    out = rows.select("row_id", "part", F.lit(0).alias("prefix"))
    for k, ids in enumerate(failing.values()):
        taken = out.withColumn("prefix", F.explode(F.array("prefix", F.col("prefix").bitwiseOR(F.lit(1 << k)))))
        gone = ids.select(F.col("row_id").alias("gone"))
        out = taken.join(gone, (F.col("row_id") == F.col("gone")) & (F.col("prefix").bitwiseAND(F.lit(1 << k)) != 0), "left_anti")
    return out


def set_counts(rows: DataFrame, failing: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``part, prefix, kept``, and ``part, filter, prefix, removed, redundant, good_lost, toxic_lost`` where a row fails the filter."""
    every, alive = range(1 << len(failing)), materialize(survivors(rows, failing), "survivors")
    kept = alive.groupBy("part", "prefix").agg(F.count("*").alias("kept"))
    of = []
    for k, (f, ids) in enumerate(failing.items()):
        before = F.array(*[F.lit(p) for p in every if not p >> k & 1])
        of.append(rows.join(ids, "row_id", "left_semi").select("row_id", "part", "good", "toxic", F.lit(f).alias("filter"), F.explode(before).alias("prefix")))
    failed = reduce(DataFrame.unionAll, of)
    there = alive.select("row_id", "prefix")
    removed = failed.join(there, ["row_id", "prefix"], "left_semi").withColumn("removed", F.lit(1))
    redundant = failed.join(there, ["row_id", "prefix"], "left_anti").withColumn("removed", F.lit(0))
    lost = lambda c: F.sum(F.when(F.col(c), F.col("removed")).otherwise(0)).alias(f"{c}_lost")
    counts = removed.unionAll(redundant).groupBy("part", "filter", "prefix").agg(F.sum("removed").alias("removed"), F.sum(1 - F.col("removed")).alias("redundant"), lost("good"), lost("toxic"))
    return kept, counts


def paths(filters: list[str]) -> list[tuple[str, int, str, int, int]]:
    """``filter_order, step, filter``, the set before the step and the set after it, for every order."""
    bit = {f: 1 << k for k, f in enumerate(filters)}
    out = []
    for order in permutations(filters):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(order), step, f, before, before | bit[f]))
            before |= bit[f]
    return out


def audit(rows: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """One row per part, order of the filters and step, zeros included."""
    spark, filters = rows.sparkSession, list(failing)
    kept, counts = set_counts(rows, failing)
    kept, counts = materialize(kept, "kept"), materialize(counts, "counts")
    steps = spark.createDataFrame(paths(filters), "filter_order string, step int, filter string, prefix int, after int")
    each = kept.select("part").distinct().select("part", F.explode(F.array(*[F.lit(f) for f in filters])).alias("filter"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = each.join(F.broadcast(steps), "filter").join(counts, ["part", "filter", "prefix"], "left")
    out = out.join(kept.withColumnRenamed("prefix", "after"), ["part", "after"], "left")
    mine = Window.partitionBy("part", "filter")  # as many rows as there are orders
    alone = F.max(F.when(F.col("after") == (1 << len(filters)) - 1, F.col("removed"))).over(mine)
    out = out.withColumns({"unique_fails": alone, "shapley": F.sum("removed").over(mine)})
    return out.select("part", "filter_order", "step", *[zero(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the query."""
    return audit(*judged_rows(docs, labels))
