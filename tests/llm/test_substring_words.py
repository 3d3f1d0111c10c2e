"""Substring deduplication decides by words: colliding hashes, widely shared lines, ids of any type."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from oppflow.llm import substring


def brute(rows, window=20):
    """``id: (n_words, n_removed)`` and kept hashes for rows in order of place."""
    seen, out = set(), {}
    for i, t in rows:
        w = (t or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if x in seen:
                gone[k : k + window] = [True] * window
            seen.add(x)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def found(docs):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digest(docs).collect()}


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_with_one_hash_are_no_copies(spark):
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    b = np.frombuffer((one + other).encode(), np.uint8)
    assert len(set(substring.word_hashes(b, np.array([0, 1024]), np.array([1024, 2048])).tolist())) == 1
    w = [f"w{k}" for k in range(30)]
    rows = [(1, " ".join([*w[:10], one, *w[11:]])), (2, " ".join([*w[:10], other, *w[11:]])), (3, " ".join([*w[:10], other, *w[11:]]))]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) and [got[k][1] for k in (1, 2, 3)] == [0, 0, 30]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == got


@pytest.mark.parametrize(("wide", "shared"), [(3, 5), (3, 10**9), (2000, 10**9)])
def test_lines_that_many_documents_share(spark, monkeypatch, wide, shared):
    monkeypatch.setattr(substring, "WIDE_ROWS", wide)
    monkeypatch.setattr(substring, "SHARED_RUNS", shared)
    rng = random.Random(5)
    lines = [[f"l{k}x{j}" for j in range(n)] for k, n in enumerate((12, 17, 19, 20, 24, 40))]
    rows = []
    for i in range(300):
        own = [rng.choice("abcdefgh") for _ in range(rng.randrange(3, 40))]
        line = lines[i % 6]
        rows.append((i, rng.choice([" ", "\n", "  "]).join([*own, *line, *own[::-1], *(line if i % 5 == 0 else [])])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(docs) == brute(rows)


def test_a_group_passes_without_being_held(monkeypatch):
    monkeypatch.setattr(substring, "WIDE_ROWS", 4)
    sizes = [1, 3, 11, 2, 1, 4, 5, 1]
    key = np.repeat(np.arange(8), sizes)
    at = np.arange(len(key)) << 5 | 1
    for step in (1, 2, 5, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[k : k + step]), pa.array(key[k : k + step]), pa.array(at[k : k + step] << 2 | 1)], ["seed", "doc", "at"]) for k in range(0, len(key), step)]
        got = sorted((d, s >> 2, s & 3) for b in substring._settle(batches) for d, s in zip(b["doc"].to_pylist(), b["span"].to_pylist(), strict=True))
        assert got == [(int(k), int(a), 1 if sizes[k] <= 4 else 2) for k, a in zip(key, at, strict=True) if sizes[k] > 1]


def test_copies_are_compared_byte_for_byte():
    raw = np.frombuffer(b"abc abd abc ab", np.uint8)
    start, end = np.array([0, 4, 8, 12]), np.array([3, 7, 11, 14])
    assert substring.copies(raw, start, end, np.zeros(4, np.uint64)).tolist() == [False, False, True, False]
    assert substring.copies(raw, start[:0], end[:0], np.zeros(0, np.uint64)).tolist() == []


def test_string_ids(spark):
    w = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([("b", w), ("a", w), (None, w), ("c", "few words")], "doc_id string, text string")
    assert {k: v[:2] for k, v in found(docs).items()} == {"a": (30, 0), "b": (30, 30), None: (30, 30), "c": (2, 0)}
