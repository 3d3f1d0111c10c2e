"""SimHash near-duplicates: fingerprints linked through sharded BK-trees.

Two fingerprints within ``radius`` bits agree in at least two of ``radius + 2``
blocks of bits, so each fingerprint belongs to one shard for each pair of
blocks, and every link lies within a shard. A shard is searched through a
BK-tree: a node's children are keyed by their Hamming distance to it, and a
search follows only the edges within the radius of its own distance. A shard
larger than ``TREE_ROWS`` is cut into several trees, and each tree meets each
part of the shard in a task of its own; so no task holds more than two parts.
The trees travel by shuffle to the tasks that search them, not by broadcast:
together they grow with the corpus. Of a shard's links a spanning forest is
kept, which joins the same components.

Defined results: null and wordless texts have fingerprint zero and are linked
like any other; equal texts share a fingerprint; repeated rows give a row each;
a component's id is its smallest document id, null ids not counted (null only
if there is no other); other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oppflow.llm.arrowtext import pieces, release, small_batches, words
from oppflow.llm.components import Forest, components
from oppflow.shared import materialize

#: Most fingerprints, about, of one BK-tree.
TREE_ROWS = 2048
_PIECE = 2 << 20


def _fingerprints(texts: pa.Array, size: int) -> np.ndarray:
    """The fingerprint of every text: a bit is 1 if set in over half of its shingles' hashes."""
    from xxhash import xxh64_intdigest

    b, start, end, count = words(texts, lower=True)
    out = np.zeros(len(count), np.uint64)
    if not len(start):
        return out
    n = end - start
    at = np.concatenate([[0], np.cumsum(n + 1)])
    body = np.full(at[-1], 32, np.uint8)  # words with one space after each
    body[np.repeat(at[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = b[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    shingles = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    ends = np.cumsum(shingles)
    s = np.repeat(first - (ends - shingles), shingles) + np.arange(ends[-1])
    e = s + np.repeat(np.minimum(count, size), shingles) - 1
    raw = body.tobytes()
    h = np.fromiter((xxh64_intdigest(raw[x:y], 42) for x, y in zip(at[s].tolist(), (at[e] + n[e]).tolist(), strict=True)), np.uint64, len(s))
    some = shingles > 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.add.reduceat(bits, (ends - shingles)[some], axis=0, dtype=np.int32)
    out[some] = np.packbits(total * 2 > shingles[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``id, fp long`` (the 64 bits) for every row."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in pieces(batches, _PIECE):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_fingerprints(b.column(1), shingle).view(np.int64))], ["id", "fp"])
        release()

    return src.mapInArrow(run, T.StructType([src.schema["id"], T.StructField("fp", T.LongType())]))


def _links(radius: int):
    """Spanning links of each shard part; rows come sorted by shard, part and role (0: tree, 1: search)."""

    def insert(root: list, x: int) -> None:
        node = root
        while d := (node[0] ^ x).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = [x, {}]
                return
            node = child

    def near(root: list, x: int):
        todo = [root]
        while todo:
            value, children = todo.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                yield value
            for k, child in children.items():
                if d - radius <= k <= d + radius:
                    todo.append(child)

    def search(values: list[int], roles: list[int]) -> list[tuple[int, int]]:
        out, forest, root = [], Forest(), None
        own = roles[-1] == roles[0]  # a part with itself
        for x, role in zip(values, roles, strict=True):
            u = x & 0xFFFFFFFFFFFFFFFF
            if root is not None and (own or role):
                for y in near(root, u):
                    if forest.join(u, y):
                        out.append((u, y))
            if not role:
                if root is None:
                    root = [u, {}]
                else:
                    insert(root, u)
        return out

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table, cuts: np.ndarray):
            values, roles = t["fp"].to_pylist(), t["role"].to_pylist()
            got = [p for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if e - s > 1 and not roles[s] for p in search(values[s:e], roles[s:e])]
            a = np.array([p[0] for p in got], np.uint64).view(np.int64)
            z = np.array([p[1] for p in got], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, z)), pa.array(np.minimum(a, z))], ["u", "v"])

        for b in batches:
            t = pa.Table.from_batches([*held, b]).combine_chunks()
            keys = np.stack([t[c].to_numpy() for c in ("shard", "part", "other")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if len(cuts):
                yield flush(t.slice(0, int(cuts[-1])), np.concatenate([[0], cuts]))
                t = t.slice(int(cuts[-1]))
            held = t.to_batches()
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield flush(t, np.array([0, t.num_rows]))

    return run


def links(distinct: DataFrame, radius: int = 4, bits: int = 64, tree_rows: int = TREE_ROWS) -> DataFrame:
    """``u, v``: links that join all of column ``fp`` (distinct values) at ``radius`` or fewer differing bits."""
    n = radius + 2
    widths = [bits // n + (k < bits % n) for k in range(n)]
    low = [sum(widths[:k]) for k in range(n)]
    block = [F.shiftrightunsigned("fp", low[k]).bitwiseAND(F.lit((1 << widths[k]) - 1)) for k in range(n)]
    pairs = list(combinations(range(n), 2))
    span = 2 * max(widths)
    shards = F.array(*[F.lit(t << span) + F.shiftleft(block[a], widths[b]) + block[b] for t, (a, b) in enumerate(pairs)])
    rows = distinct.select("fp", F.explode(shards).alias("shard"))
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1").select("shard", F.ceil(F.col("n") / tree_rows).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (
        rows.join(sizes, "shard")
        .withColumn("own", own)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("shard", F.least("own", "with").alias("part"), F.greatest("own", "with").alias("other"), (F.col("own") != F.least("own", "with")).cast("int").alias("role"), "fp")
    )
    parted = dealt.repartition("shard", "part", "other").sortWithinPartitions("shard", "part", "other", "role", "fp")
    return parted.mapInArrow(_links(radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``id, fp, component_id`` for every row of ``docs``."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(distinct, radius))
    of = distinct.join(roots, F.col("fp") == F.col("u"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(of.join(least, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """Rows of the query."""
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The row with the smallest id (null sorts last) of each component, with all its columns; equal rows stay or go together."""
    text = lambda c: F.xxhash64(F.coalesce(c, F.lit("")))
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), text(F.col(text_col)).alias("h"))
    judged = near_duplicates(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", shingle, radius)
    gone = materialize(judged.filter(F.col("id") != F.col("component_id")).select(F.col("id.id").alias("_gone"), F.col("id.h").alias("_h")).distinct(), "gone")
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]) & (text(docs[text_col]) == gone["_h"]), "left_anti")
