"""The audit of all orders of filters against applying them one after another."""

import random
import re
from itertools import permutations

import pytest

from oppflow.llm import filter_audit


def brute(docs, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))

    def fails(d, t):
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        out["E"] = t in first and (d is None or d > first[t])
        return {f for f, bad in out.items() if bad}

    rows = [(p or "", fails(d, t), d in good, d in toxic) for d, t, p in docs]
    out = {}
    for part in {r[0] for r in rows}:
        mine, shares = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in mine) - len(gone)
                steps.append(("".join(order), step, f, len(left), len(gone), redundant, sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)))
                shares[f] += len(gone)
        for s in steps:
            out[part, s[0], s[1]] = (*s[3:], shares[s[2]])
    return out


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x", "x", "x") for r in docs], "doc_id long, text string, lang string, row_id string, part string, prefix string")
    got = filter_audit.digest(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in got.collect()}


@pytest.fixture(scope="module")
def made():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)] + ["BIG", "WORD", "#", "a|b", "é"]

    def text():
        n = rng.choice([0, 3, 99, 100, 130, 300])
        return rng.choice([" ", "\n", "\t "]).join(rng.choices(words[: rng.choice([60, 405])], k=n)) + rng.choice(["", " ", "$"])

    texts = [text() for _ in range(120)] + [None, "", " \n", "X" * 40]
    docs = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(400)]
    docs += [(None, docs[0][1], "en"), (None, "alone here without an id", "en"), (None, "alone here without an id", "en"), (7, docs[7][1], "en"), (7, docs[9][1], "de"), (900, "word " * 200000, "fr")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 400, 2)] + [(0, 1, 1), (0, 0, 0), (None, 1, 1), (12345, 1, 1)]
    return docs, labels


def test_equals_applying_the_filters_in_turn(spark, made):
    got, want = audited(spark, *made), brute(*made)
    assert got == want and len(got) == 120 * 5 * 4


def test_hot_texts_are_dealt(spark, made, monkeypatch):
    docs, labels = [(k, "the same text" if k % 3 else f"text {k}", "en") for k in range(300)], made[1]
    want = brute(docs, labels)
    monkeypatch.setattr(filter_audit, "HOT_ROWS", 10)
    assert audited(spark, docs, labels) == want


def test_empty_tables(spark, made):
    assert audited(spark, [], made[1]) == {}
    assert audited(spark, made[0][:9], []) == brute(made[0][:9], [])
