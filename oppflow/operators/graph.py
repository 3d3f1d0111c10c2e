"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from oppflow.operators.joins import hot_keys
from oppflow.shared import materialize

#: Edges that a task contracts at a time before the first shuffle.
_LOCAL = 500_000
#: Edges of one node, at least, from which on they stay where they are and the node's row is sent to them.
HOT_EDGES = 256


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up, root = self.up, x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def join(self, a, b) -> bool:
        """Whether the two were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


def _contract(kind: pa.DataType):
    """Each run of edges as stars around its smallest members: same components, fewer and flatter edges."""

    def run(batches):
        forest, n = Forest(), 0

        def stars():
            pairs = [(x, r) for x in forest.up if (r := forest.find(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind) for k in (0, 1)], ["u", "v"])

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                forest.join(u, v)
            n += b.num_rows
            if n >= _LOCAL:
                yield stars()
                forest, n = Forest(), 0
        if n:
            yield stars()

    return run


def _with_least(edges: DataFrame, least: DataFrame, key: str, total: int) -> DataFrame:
    """``edges`` with ``m``: what ``least`` (node, m) says about the node in ``key``, or null.

    A node with very many edges would be one task's work: its row is broadcast
    to them instead. There are few such nodes, however large the graph.
    """
    rows = least.withColumnRenamed("node", key)
    hot = hot_keys(edges, key, total, HOT_EDGES)
    if hot is None:
        return edges.join(rows, key, "left")
    mark = F.broadcast(hot.select(key, F.lit(True).alias("hot")))
    marked = edges.join(mark, key, "left")
    few = F.broadcast(mark.join(rows, key).select(key, "m"))
    return marked.filter("hot").drop("hot").join(few, key, "left").unionByName(marked.filter("hot IS NULL").drop("hot").join(rows, key, "left"))


def components(edges: DataFrame, one_task: int = 0) -> DataFrame:
    """``u, root`` for every node of ``edges`` (``u, v`` of one type that sorts) but the roots themselves; root is the least node of its component.

    The number of rounds grows with the logarithm of the longest chain; each
    round is written to the shared folder. Up to ``one_task`` edges, counted
    after tasks have contracted theirs, are contracted by a single task instead.
    """
    kind = edges.schema["u"].dataType
    schema = T.StructType([T.StructField("u", kind), T.StructField("v", kind)])
    least = lambda e: e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    # every edge leads from the larger node to the smaller one
    now, before = materialize(edges.select("u", "v").mapInArrow(_contract(to_arrow_type(kind)), schema).distinct(), "edges"), None
    total = now.count()
    if total <= min(one_task, _LOCAL - 1):
        return now.coalesce(1).mapInArrow(_contract(to_arrow_type(kind)), schema).withColumnRenamed("v", "root")
    while True:
        # large star: the larger node is linked to the least neighbour of the smaller one
        down = _with_least(now, least(now), "v", total).select("u", F.coalesce("m", "v").alias("v")).distinct()
        # small star: all smaller neighbours of a node are linked to their least one
        small = _with_least(down, least(down), "u", total)
        both = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        now = materialize(small.select(F.explode(both).alias("e")).select("e.*").filter("u <> v").distinct(), "edges")
        total, mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (total, mark) == before:
            return now.select("u", F.col("v").alias("root"))
        before = (total, mark)
