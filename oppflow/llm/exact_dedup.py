"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its own characters say so, each chunk gets an
identifier, and texts are compared by their ordered identifier lists (recipes).
A chunk's text moves once, for the verification of its identifier: the distinct
(identifier, chunk) pairs are gathered, already combined within each task, and
an identifier with two different chunks is found there. In recipes such an
identifier is replaced by the chunk itself, so equal recipes always mean equal
texts. Everything after that works on recipes, some bytes a document.

Defined results: null counts as empty; all empty texts are one group; of a
group the row with the most code points in its original text, then the
smallest id, stays (a null id sorts last); repeated rows with the same id are
rows of their own, only one of a group being kept (:func:`dedupe` judges by id
and text, so rows equal in both stay or go together); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oppflow.shared import freeing_shuffles, materialize

#: A chunk has 256 to 4096 code points and ends early after this mark, which text has every few hundred characters.
CUT = r"(?s).{256,4096}?(?:[a-mA-M][n-zN-Z][aeiou\d][c-h]|[^\x00-\x7F][^\x00-\x7F][a-m])|.{1,4096}"


def without_space(c: Column) -> Column:
    """``c`` without the characters ``[\\x20\\x09-\\x0D]``; null becomes empty."""
    c = F.coalesce(c, F.lit(""))
    for ch in (" ", "\t", "\n", "\x0b", "\x0c", "\r"):
        c = F.replace(c, F.lit(ch), F.lit(""))
    return c


def chunks(c: Column) -> Column:
    """The content-defined chunks of a text, in order; joined they are the text."""
    return F.regexp_extract_all(c, F.lit(CUT), F.lit(0))


def chunk_id(c: Column) -> Column:
    """A chunk's identifier before verification."""
    return F.xxhash64(c)


def ambiguous_ids(norm: DataFrame, ident=chunk_id) -> list[int]:
    """Identifiers that stand for more than one chunk text, read from all distinct chunks of column ``norm``."""
    distinct = norm.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(ident(F.col("chunk")).alias("cid"), "chunk").distinct()
    with freeing_shuffles(norm.sparkSession):
        return [r.cid for r in distinct.groupBy("cid").count().filter("count > 1").select("cid").collect()]


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ident=chunk_id) -> DataFrame:
    """One row per document: ``row_id, id, keep_id, group_size, kept, text_sha256``."""
    spark = docs.sparkSession
    norm = docs.select(F.col(id_col).alias("id"), F.coalesce(F.char_length(text_col), F.lit(0)).alias("n"), without_space(F.col(text_col)).alias("norm"))
    bad = ambiguous_ids(norm, ident)
    step = lambda c: F.struct(ident(c).alias("cid"), (F.when(ident(c).isin(bad), c) if bad else F.lit(None).cast("string")).alias("exact"))
    listed = materialize(
        norm.select(F.monotonically_increasing_id().alias("row_id"), "id", "n", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.transform(chunks(F.col("norm")), step).alias("recipe")),
        "recipes",
    )
    # of a group: most code points, then smallest id (null last), then first row
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row_id")))
    of = listed.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size")).select(F.xxhash64("recipe").alias("h"), "recipe", F.col("best.id").alias("keep_id"), F.col("best.row_id").alias("keep_row"), "group_size")
    rows = listed.withColumn("h", F.xxhash64("recipe"))
    return rows.join(of, ["h", "recipe"]).select("row_id", "id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256")


def digest(docs: DataFrame) -> DataFrame:
    """Rows of the query."""
    return groups(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows with equal ids and equal texts stay or go together."""
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    gone = groups(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text").filter(F.col("id") != F.col("keep_id")).select(F.col("id.id").alias("_gone"), F.col("id.h").alias("_h")).distinct()
    gone = materialize(gone, "gone")  # its size is known now: a small one is broadcast, and the texts stay where they are
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == gone["_h"]), "left_anti")
