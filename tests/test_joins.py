"""Joins and components with keys that hold a large share of all rows, and ids of any type."""

import random

import pytest
from pyspark.sql import functions as F

from oppflow.operators import graph, joins


@pytest.mark.parametrize("least", [3, 10, 10**6])
def test_salted_join_is_the_plain_one(spark, least):
    rows = [(0 if k % 3 else k, k) for k in range(90)] + [(None, -1)]
    left = spark.createDataFrame(rows, "k long, x long").repartition(4)
    right = spark.createDataFrame([(k, k * 10) for k in range(0, 60)], "k long, y long")
    got = sorted(map(tuple, joins.salted_join(left, right, "k", F.col("x"), len(rows), least).select("k", "x", "y").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").collect()))


def test_few_keys_are_hot(spark):
    left = spark.createDataFrame([(0 if k % 3 else k,) for k in range(90)], "k long")
    assert joins.hot_keys(left, "k", 90, 90) is None
    assert [(r.k, r.parts) for r in joins.hot_keys(left, "k", 90, 20).collect()] == [(0, 4)]


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("hot", [2, 256])
def test_components_with_hubs(spark, monkeypatch, kind, hot):
    monkeypatch.setattr(graph, "HOT_EDGES", hot)
    rng = random.Random(1)
    edges = [(k, 0) for k in range(1, 120)] + [(900, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(k, k + 1) for k in range(500, 540)] + [(7, 7)]
    edges = [(str(a), str(b)) for a, b in edges] if kind == "string" else edges
    rng.shuffle(edges)
    want = graph.Forest()
    for a, b in edges:
        want.join(a, b)
    got = {r.u: r.root for r in graph.components(spark.createDataFrame(edges, f"u {kind}, v {kind}").repartition(5)).collect()}
    nodes = {x for e in edges for x in e}
    assert {x: got.get(x, x) for x in nodes} == {x: want.find(x) for x in nodes}
