"""The pipeline's near-dedup against all pairs."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from oppflow.llm import similar
from oppflow.llm.components import Forest


def shingles(t, k=5):
    w = t.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if rows[i][1] == rows[j][1] or (a and b and len(a & b) >= 0.8 * len(a | b)):
                up[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted(least.values())


def edited(rng, base, n):
    w = base.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_links_all_pairs_of_word_shingles(spark):
    rng = random.Random(7)
    rows, line = [(1, ""), (2, "a b"), (3, "A  b")], " ".join(f"license{i}" for i in range(15))
    for g in range(30):
        base = " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(60, 200)))
        rows.append((100 * (g + 1), base + " " + line))
        for k in range(6):  # from near to well below the threshold
            base = base if k % 2 else edited(rng, base, 1)
            rows.append((100 * (g + 1) + k + 1, edited(rng, base, k + 1) + " " + line))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute(rows)
    assert 40 < len(want) < len(rows) - 40
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == want


def test_near_takes_what_simhash_links(spark, monkeypatch):
    """Where no band brings two texts together, near copies still meet by their fingerprints."""
    rng = random.Random(3)
    rows = []
    for g in range(8):
        base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(800))
        rows += [(10 * g + 1, base), (10 * g + 2, edited(rng, base, 1)), (10 * g + 3, base + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [*rows, (98, ""), (99, " \n")]], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute([*rows, (98, ""), (99, " \n")])
    assert want == [*range(1, 80, 10), 98, 99]
    plain = similar.marks
    monkeypatch.setattr(similar, "marks", lambda *a: plain(*a).withColumn("bands", F.transform("bands", lambda b: F.xxhash64("h", b))))
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == want


def test_alike_texts_of_a_band_give_fewer_links_than_texts():
    """All pairs of a band agree; the links that leave the task join them all, and no others."""
    m = 150
    sets = [list(range(100)) if k < m // 2 else list(range(1000, 1100)) for k in range(m)]
    batch = pa.RecordBatch.from_pydict(
        {
            "band": pa.array([5] * m, pa.int64()),
            **{c: pa.array([0] * m, pa.int32()) for c in ("part", "other", "role")},
            "h": pa.array(range(m), pa.int64()),
            "n": pa.array([100] * m, pa.int32()),
            "root": pa.array(range(m), pa.int64()),
            "leads": pa.array([0] * m, pa.int64()),
            "low": pa.array([bytes(similar.BANDS * similar.ROWS)] * m),
            "keys": pa.array([(5).to_bytes(4, "little") * similar.BANDS] * m),
            "shingles": pa.array(sets, pa.list_(pa.int64())),
        }
    )
    links = [(x["u"], x["v"]) for b in similar._compare(iter([batch])) for x in b.to_pylist()]
    up = Forest()
    for u, v in links:
        assert (u < m // 2) == (v < m // 2)
        up.join(u, v)
    assert len(links) == m - 2 and {up.find(k) for k in range(m)} == {0, m // 2}
