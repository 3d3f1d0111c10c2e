"""Equi-joins in which single keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No more than so many keys count as hot: each of them holds more than this part of all rows, so their table is small.
MOST_HOT = 10_000


def hot_keys(df: DataFrame, key: str, total: int, least: int, counts: DataFrame | None = None) -> DataFrame | None:
    """``key, parts`` of the keys with more than ``least`` of the ``total`` rows of ``df``, or None where there can be none.

    A key's parts are its rows over that number. At most ``MOST_HOT`` rows. ``counts``: ``key, n`` where they are known.
    """
    if total <= least:
        return None
    most = max(least, total / MOST_HOT)
    counts = df.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    return counts.filter((F.col("n") > most) & F.col(key).isNotNull()).select(key, F.ceil(F.col("n") / most).cast("int").alias("parts"))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column, total: int, least: int = 50_000, counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` (a row for each key); a key's rows in ``left`` (``total`` in all) are dealt by ``spread`` if they are many."""
    hot = hot_keys(left, key, total, least, counts)
    if hot is None:
        return left.join(right, key)
    hot, parts = F.broadcast(hot), F.coalesce("parts", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("parts")
    each = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(each, [key, "_part"]).drop("_part")
