"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents``; the last one
returns the token digest of what is left. Rows are judged by their own id and
text; ids may be null or repeated, and rows equal in both stay or go together
(in mixing, rows equal in id and cell).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oppflow.llm import bpe, exact_dedup, langid, mixing, similar
from oppflow.shared import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if its main language has less than this share of its letters.
LEAST_SHARE = 0.4
#: Bytes of text in a chunk of the last stage: its workers run in executors whose heaps the stages before have filled.
TOKEN_CHUNK = 4 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter, or no main language."""
    model = langid.learn(docs, ~langid.held_out(F.col("doc_id")))
    key = F.struct(F.col("doc_id").alias("id"), similar.node(F.col("text")).alias("h"))
    said = langid.identify(docs.select(key.alias("key"), "text"), model, "key")
    gone = materialize(said.filter((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SHARE)).select(F.col("id.id").alias("_gone"), F.col("id.h").alias("_h")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]) & (similar.node(docs["text"]) == gone["_h"]), "left_anti").select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.dedupe(docs).select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: classes by SimHash and BK-trees, checked by five-word shingles at a Jaccard similarity of 0.8 or more; min-hash bands bring what fingerprints leave apart."""
    return similar.dedupe(docs).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample at the calibrated probabilities."""
    return mixing.mix(docs).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of the documents that are left, encoded and decoded."""
    return bpe.digest(docs, bpe.public_path("byte_bpe_50k.json"), TOKEN_CHUNK)


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mixture), ("BPE", tokens)]

#: The stages hold trained models, fingerprints and a tokenizer: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
