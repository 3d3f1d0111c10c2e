"""The pipeline's stages against plain versions of them."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from oppflow.llm import bpe, langid, mixing, queries


def test_stages_decide_and_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.union(spark.createDataFrame([(10**6, "123 456", "en", "src0", 7), (10**6 + 1, None, None, None, None)], docs.schema)).cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "mixing", "BPE"]
    lang = corpus_pipeline.language(spark, docs, sf_dir).cache()
    assert lang.columns == corpus_pipeline.COLUMNS
    left = {r.doc_id for r in lang.collect()}
    assert 10**6 not in left and 10**6 + 1 not in left and len(left) >= 0.98 * (docs.count() - 2)
    exact = corpus_pipeline.exact(spark, lang, sf_dir).cache()
    texts = {re.sub(r"[\x20\x09-\x0d]", "", r.text) for r in lang.collect()}
    assert exact.count() == len(texts)
    near = corpus_pipeline.near(spark, exact, sf_dir).cache()
    assert near.columns == corpus_pipeline.COLUMNS and len(texts) * 0.9 < near.count() <= len(texts)
    mixed = corpus_pipeline.mixture(spark, near, sf_dir).cache()
    kept = {r.id for r in mixing.sample(near).filter("kept").collect()}
    assert {r.doc_id for r in mixed.collect()} == kept and 0 < len(kept) < near.count()
    last = corpus_pipeline.tokens(spark, mixed, sf_dir).collect()
    t = bpe.tokenizer(bpe.public_path("byte_bpe_50k.json"))
    assert {r.doc_id: r.n_tokens for r in last} == {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) for r in mixed.collect()}


def test_run_is_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert out.filter(F.col("n_tokens") > 0).count() == out.count() > 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert langid.held_out(F.lit(1)) is not None
