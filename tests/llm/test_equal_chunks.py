"""Chunks of one word list: each is a group of its own, and the ids are right."""

from oppflow.llm import bpe


def test_equal_chunks_stay_apart(spark):
    path = bpe.public_path("byte_bpe_50k.json")
    text = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(k, text) for k in range(60)] + [(None, text), (7, None)], "doc_id long, text string").repartition(3)
    out = bpe.encode(docs, path, chunk_bytes=1)
    want = bpe.tokenizer(path).encode(text, add_special_tokens=False).ids
    rows = out.collect()
    assert len(rows) == 62 and sum(r.ids == want for r in rows) == 61 and sum(r.ids == [] for r in rows) == 1

