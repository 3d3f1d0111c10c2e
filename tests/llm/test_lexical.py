"""Search by term owners against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oppflow.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, top=10):
    own = [(d, Counter(ts), len(ts)) for d, t in docs if (ts := terms(t))]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for at, (d, c, n) in enumerate(own):
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = 0
            for t, times in Counter(terms(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d, at))
        out += [(item, rank, s[2], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0, s[3]))[:top], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, "x", "x") for i, t in docs], "doc_id long, text string, shard string, row_id string")
    q = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(d, q, **how)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["É", "İx", "日本", "A1b", "common"]
    weights = [1 / (k + 1) for k in range(len(words) - 1)] + [2.0]
    text = lambda n: "".join(w.upper() + rng.choice([" ", "-", "\n", ", ", "\x00", "_"]) if rng.random() < 0.2 else w + " " for w in rng.choices(words, weights, k=n))
    docs = [(k, text(rng.choice([1, 5, 30, 200]))) for k in range(300)]
    docs += [(k + 400, "the same text of common w1 w2") for k in range(40)]  # ties
    docs += [(None, "w1 w50 common"), (None, "w1 w50 common"), (5, "w3 w3 w3"), (5, "w3 w3 w3"), (700, None), (701, " ,;"), (702, "w7 " * 400000)]
    rng.shuffle(docs)
    items = [(k, text(25)) for k in range(12)] + [(50, "w1 w1 w2 COMMON"), (50, "w50"), (51, None), (52, "nowhere to be found?"), (None, "w3"), (53, "...")]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"shard_docs": 20, "owners": 3}, {"shard_docs": 50, "owners": 9, "block_items": 4}, {"shard_docs": 1000, "owners": 1, "block_terms": 30}])
def test_equals_scoring_every_document(spark, corpus, how):
    docs, items = corpus
    assert found(spark, docs, items, **how) == brute(docs, items)


def test_other_numbers_of_results(spark, corpus):
    docs, items = corpus
    assert found(spark, docs, items[:5], top=3, shard_docs=64) == brute(docs, items[:5], 3)


def test_empty_tables(spark, corpus):
    docs, items = corpus
    assert found(spark, [], items) == found(spark, docs[:5], []) == found(spark, [(1, None), (2, "?")], items) == []


def test_ids_of_another_type(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "three")], "doc_id string, text string")
    got = lexical.search(docs, spark.createDataFrame([("q", "two")], "item_id string, text string")).orderBy("rank").collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in got] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)]


def test_documents_go_only_when_they_cannot_win():
    none = np.zeros(0, np.int32), np.zeros(0, np.int64)
    at, part = np.arange(20, dtype=np.int32), np.arange(100, 120, dtype=np.int64)
    docs, scores = lexical.added(*none, [(at, part, 1)], 5, 10)
    assert docs.tolist() == list(range(5, 20)) and scores.tolist() == list(range(105, 120))
    assert len(lexical.added(*none, [(at, part, 1)], 1000, 10)[0]) == 20
    assert len(lexical.added(*none, [(at, np.full(20, 7), 1)], 0, 10)[0]) == 20  # ties all stay


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(5000))
    whole = lexical.count_terms(text)
    monkeypatch.setattr(lexical, "_CUT", 100)
    assert lexical.count_terms(text) == whole and whole[0] == 5000


def test_query_over_given_tables(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = sorted((tuple(r) for r in lexical.digest(docs, items).collect()), key=str)
    rows = lambda df, *c: [tuple(r) for r in df.select(*c).collect()]
    assert got == brute(rows(docs, "doc_id", "text"), rows(items, "item_id", "text"))
    assert items.filter(F.col("text").isNotNull()).count() > 0
