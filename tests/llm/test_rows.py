"""Stages decide by rows: null and repeated ids take no other document with them."""

import random

import corpus_pipeline
from oppflow.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)


def texts(df):
    return sorted((r.doc_id or 0, r.text) for r in df.collect())


def test_exact_dedup_drops_only_the_copies(spark):
    rows = [(1, "a copy"), (None, "a copy"), (None, "clean"), (2, "a copy"), (2, "other"), (3, "x  y"), (3, "x y")]
    assert texts(corpus_pipeline.exact(spark, table(spark, rows), "")) == [(0, "clean"), (1, "a copy"), (2, "other"), (3, "x  y")]


def test_near_dedup_drops_only_the_copies(spark):
    rng = random.Random(3)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(3))
    rows = [(1, a), (None, a + " more"), (None, b), (2, a + " end"), (2, c)]
    assert texts(corpus_pipeline.near(spark, table(spark, rows), "")) == sorted([(0, b), (1, a), (2, c)])


def test_language_drops_only_the_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    text = docs.filter("lang = 'en'").first().text
    extra = [(None, text), (None, "123 456"), (10**6, text), (10**6, "123 456")]
    left = corpus_pipeline.language(spark, docs.union(table(spark, extra)), sf_dir).filter(f"doc_id is null or doc_id = {10**6}")
    assert texts(left) == [(0, text), (10**6, text)]


def test_mixing_samples_rows_without_ids(spark):
    rows = [(None, f"text {i}", "en", "ab"[i % 3 == 0], 9) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    probability = mixing.sample(docs).toPandas().probability
    kept = mixing.mix(docs).count()
    assert probability.min() < 0.9 and abs(kept / len(rows) - probability.mean()) < 0.08
