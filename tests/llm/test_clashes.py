"""Internal names as input columns, refused ids, labels out of range, and samples of rows without ids."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oppflow.llm import bpe, exact_dedup, langid, mixing, quality, similar, simhash, token_files

NAMES = ["_gone", "_h", "_id", "_fp", "_source", "_lang", "_topic", "_probability", "_chance", "_part", "u", "root", "row", "hot", "parts", "keep_id", "component_id", "h", "n", "band"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(2)
    a = " ".join(f"w{rng.randrange(500)}" for _ in range(80))
    rows = [(1, a, "en", "s", 1), (2, a + " end", "en", "s", 1), (3, a, "fr", "t", 1), (4, "another text altogether", None, None, 1), (None, a, "en", "s", 1)]
    return spark.createDataFrame([(*r, *("x" for _ in NAMES)) for r in rows], SCHEMA)


@pytest.mark.parametrize(("dedupe", "left"), [(exact_dedup.dedupe, [1, 2, 4]), (similar.dedupe, [1, 4]), (simhash.dedupe, None), (mixing.mix, None)])
def test_names_of_the_input_do_not_clash(clashing, dedupe, left):
    out = dedupe(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert all(r[n] == "x" for r in rows for n in NAMES)
    if left:
        assert sorted(r.doc_id for r in rows) == left


def test_stages_take_tables_with_clashing_names_and_empty_ones(spark, clashing, sf_dir):
    for docs in (clashing, clashing.filter("false")):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, docs, sf_dir).collect()
            assert len(rows) <= 5 and (len(rows) > 0) == (docs is clashing)


def test_simhash_dedupe_drops_copies_without_ids(spark):
    docs = spark.createDataFrame([(None, "one text"), (2, "one text"), (2, "some other text"), (2, "one text"), (None, "alone here it is")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in simhash.dedupe(docs).collect())
    assert got == [(0, "alone here it is"), (2, "one text"), (2, "one text"), (2, "some other text")]


def test_token_files_refuse_other_ids(spark):
    with pytest.raises(ValueError, match="whole numbers"):
        token_files.digest(spark.createDataFrame([("a", "b")], "doc_id string, text string"), bpe.public_path("word_bpe_49k.json"))


def test_quality_of_few_labels(spark):
    docs = spark.createDataFrame([(1, "good words stand here"), (2, "zz## ##zz 11 !!"), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 7), (3, None)], "doc_id long, quality int")
    one = {r.id: r.score for r in quality.score(docs, quality.learn(docs, labels, F.lit(True))).collect()}
    assert one[1] > 0.6 > 0.4 > one[2]


def test_language_sample_is_bounded_without_ids(spark):
    docs = spark.createDataFrame([(None, f"the text of number {k}", "en" if k % 2 else "fr") for k in range(400)], "doc_id long, text string, lang string")
    seen = langid.learn(docs, F.lit(True), rows=40)
    everything = langid.learn(docs, F.lit(True), rows=10**6)
    assert seen["langs"] == everything["langs"] == ["en", "fr"]


def test_bpe_of_a_source_that_is_no_table(spark):
    path = bpe.public_path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(k, f"text {k % 7} " + "abc" * k) for k in range(60)], "doc_id long, text string").repartition(7).distinct()
    t = bpe.tokenizer(path)
    got = {r.doc_id: r.ids for r in bpe.encode(docs, path, chunk_bytes=500, buckets=5).collect()}
    assert got == {r.doc_id: t.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}


def test_known_words_are_bounded(monkeypatch):
    path = bpe.public_path("byte_bpe_50k.json")
    monkeypatch.setattr(bpe, "_cache", {})
    words = [f" w{k}" for k in range(300)] + [" long" * 50]
    want = bpe.encode_words(path, words)
    for part in (words, words[::-1], words[:50]):
        flat, n = bpe.known(path, part, size=100)
        ids, m = bpe.encode_words(path, part)
        assert flat.tolist() == ids.tolist() and n.tolist() == m.tolist()
        assert all(len(x) <= 200 for x in bpe._cache[path, "encode_words"])
    assert len(want[1]) == 301


def test_both_ways_of_decoding_are_one(spark):
    path = bpe.public_path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "é à 日本 🙂 text"), (2, None), (3, "x " * 900)], "doc_id long, text string")
    apart = {r.doc_id: (r.ids, r.decoded) for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert apart == {r.doc_id: (r.ids, r.decoded) for r in bpe.encode(docs, path, decoded=True).collect()} and apart[1][1] == "é à 日本 🙂 text"
