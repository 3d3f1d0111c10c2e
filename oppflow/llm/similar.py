"""Near copies of texts: every pair whose word shingles reach a Jaccard similarity is linked.

A text's shingles are its runs of ``SHINGLE`` words (ASCII letters lowered; one
run of all words if there are fewer), compared as sets of 64-bit hashes.
SimHash comes first (``simhash``): fingerprints, BK-trees in shards and
components give classes of texts, and each text of a class is checked by its
exact similarity against the least one. The texts that reach it are one
component from then on.

Fingerprints alone do not find all: copies at 0.8 differ in up to 13 of 64
bits, and blocks that survive 13 differences are too short to part a large
corpus. So min-hash bands bring together what SimHash left apart: two texts at
the least similarity share no band with a probability of
``(1 - 0.8 ** ROWS) ** BANDS``, below one in a million. In a band first all
texts meet the least one, unless SimHash has linked the two; texts linked by
that are one component and need not meet again. So a large group of near copies
costs one check at most for each of its texts and bands. What is left are bands
with several components. Their texts are compared within tasks by the low bytes
of all their min-hashes, in parts of ``PART_ROWS`` texts and ``PART_SHINGLES``
shingles; those that agree in as many as texts at the least similarity do but
for one pair in a million are checked there by their shingles, unless links
found before have joined them. So a task gives fewer links than it has texts.
Every link is checked exactly: nothing below the threshold is linked.

Defined results: null counts as empty; equal texts are one node; texts without
words are linked to no other; nodes are 64-bit hashes of the texts; of a
component the row with the smallest id stays (a null id sorts last); equal rows
stay or go together; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oppflow.llm import simhash
from oppflow.llm.arrowtext import buffers, lists, pieces, release, small_batches, string_view, words
from oppflow.llm.components import Forest, components
from oppflow.operators.joins import salted_join
from oppflow.shared import materialize

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 48, 6
#: Texts that may meet one other text in one task.
MOST_MEETINGS = 2000
#: Texts of a band that are compared at a time with as many others, and the shingles that they have together.
PART_ROWS, PART_SHINGLES = 2048, 1 << 20
#: Min-hashes in which texts at the least similarity agree but for one pair in a million (five deviations below what is expected).
LEAST_EQUAL = int(BANDS * ROWS * LEAST - 5 * (BANDS * ROWS * LEAST * (1 - LEAST)) ** 0.5)
_PIECE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(42)
_XOR = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_TIMES = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def node(text: Column) -> Column:
    """The node of a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every text, in order of text and hash, and their number for each text."""
    from xxhash import xxh64_intdigest

    b, start, end, count = words(texts, lower=True)
    raw = b.tobytes()
    h = np.fromiter((xxh64_intdigest(raw[x:y], 42) for x, y in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    ends = np.cumsum(n)
    at = np.repeat(np.cumsum(count) - count - (ends - n), n) + np.arange(n.sum())
    left = np.repeat(np.minimum(count, size), n)
    out = left.astype(np.uint64)
    for k in range(size):
        more = np.flatnonzero(left > k)
        x = (out[more] ^ h[at[more] + k]) * _MIX
        out[more] = x ^ (x >> np.uint64(29))
    doc = np.repeat(np.arange(len(count)), n)
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], np.bincount(doc[new], minlength=len(count))


def _bands(hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bands of every text that has shingles, and the low bytes of its min-hashes."""
    first = (np.cumsum(count) - count)[count > 0]
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    out, low = np.empty((len(first), BANDS), np.uint64), np.empty((len(first), BANDS * ROWS), np.uint8)
    for band in range(BANDS):
        key = np.full(len(first), band + 1, np.uint64) * _MIX
        for k in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat((short ^ _XOR[k]) * _TIMES[k], first)
            low[:, k] = least & np.uint32(255)
            key = (key ^ least) * _MIX
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out, low


def marks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``h, n, bands, low, keys`` of every row whose text has words: its node, number of shingles, bands, low bytes of its min-hashes, 32 bits of each band."""
    small_batches(docs.sparkSession)
    src = docs.select(node(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))

    def run(batches):
        for b in pieces(batches, _PIECE):
            hashes, count = _shingles(b.column(1), SHINGLE)
            some = count > 0
            if some.any():
                bands, low = _bands(hashes, count)
                of = lists(pa.array(bands.view(np.int64).ravel()), np.full(len(bands), BANDS))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(some)), pa.array(count[some].astype(np.int32)), of, string_view(np.arange(len(low) + 1) * low.shape[1], low.ravel(), pa.binary()), string_view(np.arange(len(bands) + 1) * BANDS * 4, bands.astype("<u4").view(np.uint8).ravel(), pa.binary())], ["h", "n", "bands", "low", "keys"])
        release()

    return src.mapInArrow(run, "h long, n int, bands array<long>, low binary, keys binary")


def _sets(nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """``h, shingles`` of the texts whose nodes are in ``h``."""
    nodes = materialize(nodes.distinct(), "asked")
    texts = docs.select(node(F.col(text_col)).alias("h"), F.col(text_col).alias("text")).join(nodes, "h", "left_semi").dropDuplicates(["h"])

    def sets(batches):
        for b in pieces(batches, _PIECE):
            hashes, count = _shingles(b.column(1), SHINGLE)
            yield pa.RecordBatch.from_arrays([b.column(0), lists(pa.array(hashes.view(np.int64)), count)], ["h", "shingles"])
        release()

    return materialize(texts.mapInArrow(sets, "h long, shingles array<long>"), "sets")


def _similar(pairs: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Those of ``u, v`` whose texts have words and reach ``LEAST``."""
    held = _sets(pairs.select(F.explode(F.array("u", "v")).alias("h")), docs, text_col)
    u = held.select(F.col("h").alias("u"), F.col("shingles").alias("a"))
    v = held.select(F.col("h").alias("v"), F.col("shingles").alias("b"))
    # a text that very many others meet is sent to them in parts
    joined = salted_join(pairs, v, "v", F.col("u"), pairs.count(), MOST_MEETINGS).join(u, "u")
    both = F.size(F.array_intersect("a", "b"))
    return materialize(joined.filter((both > 0) & (both >= F.lit(LEAST) * (F.size("a") + F.size("b") - both))).select("u", "v"), "similar")


def _close(a: str, b: str) -> Column:
    """Sets of so many shingles can reach ``LEAST``."""
    return F.least(a, b) >= F.lit(LEAST) * F.greatest(a, b)


def _compare(batches):
    """Links ``u, v`` that join all similar texts of different components; rows are sorted by ``band, part, other, role`` (role 0: part, 1: other).

    Two texts that share several bands are looked at in the first of them only, and not at all if one is the least of a band
    that they share (bits of ``leads``): with that one all others of the band have been compared. Pairs that earlier links
    have joined are passed over.
    """

    def linked(t: pa.Table, cuts: np.ndarray):
        h, n, root, role = (t[c].to_numpy() for c in ("h", "n", "root", "role"))
        low = np.frombuffer(buffers(t["low"].combine_chunks())[1], np.uint8).reshape(len(h), -1)
        keys = np.frombuffer(buffers(t["keys"].combine_chunks())[1], "<u4").reshape(len(h), -1)
        band = t["band"].to_numpy().astype(np.uint32)
        leads = np.unpackbits(t["leads"].to_numpy().view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little")[:, :BANDS].astype(bool)
        shingles = t["shingles"].combine_chunks()
        at, shingles = shingles.offsets.to_numpy(), shingles.values.to_numpy()
        forest, u, v, todo, size = Forest(), [], [], [], 0

        def agree(i: np.ndarray, j: np.ndarray):
            ok = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= LEAST * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            if not len(i):
                return
            same = keys[i] == keys[j]
            ok = (keys[i, same.argmax(axis=1)] == band[i]) & ~(same & (leads[i] | leads[j])).any(axis=1)
            i, j = i[ok], j[ok]
            ok = (low[i] == low[j]).sum(axis=1) >= LEAST_EQUAL
            for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                a, z = int(root[x]), int(root[y])
                if forest.find(a) == forest.find(z):
                    continue
                both = len(np.intersect1d(shingles[at[x] : at[x + 1]], shingles[at[y] : at[y + 1]], assume_unique=True))
                if both >= LEAST * (n[x] + n[y] - both):
                    forest.join(a, z)
                    u.append(max(h[x], h[y]))
                    v.append(min(h[x], h[y]))

        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            k = int((role[s:e] == 0).sum())
            own = k == e - s  # a part with itself
            if own and k <= 64:  # small groups are put together
                x, y = np.triu_indices(k, 1)
                todo.append((x + s, y + s))
                size += len(x)
                if size >= 20_000:
                    agree(*(np.concatenate(z) for z in zip(*todo, strict=True)))
                    todo, size = [], 0
                continue
            for i in range(s, s + k):
                j = np.arange(i + 1 if own else s + k, e)
                agree(np.full(len(j), i), j)
        if todo:
            agree(*(np.concatenate(z) for z in zip(*todo, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v)], ["u", "v"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        t = pa.Table.from_batches([*held, b]).combine_chunks()
        keys = np.stack([t[c].to_numpy() for c in ("band", "part", "other")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if len(cuts):
            yield linked(t.slice(0, int(cuts[-1])), np.concatenate([[0], cuts]))
            t = t.slice(int(cuts[-1]))
        held = t.to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield linked(t, np.array([0, t.num_rows]))
    release()


def links(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``u, v``: links that join all nodes of ``docs`` at a similarity of ``LEAST`` or more."""
    nodes = materialize(marks(docs, text_col).dropDuplicates(["h"]), "marks")
    judged = simhash.near_duplicates(docs.select(node(F.col(text_col)).alias("h"), F.col(text_col).alias("text")), "h", "text")
    known = _similar(materialize(judged.filter("id <> component_id").select(F.col("id").alias("u"), F.col("component_id").alias("v")).distinct(), "classes"), docs, text_col)
    rows = nodes.join(known, F.col("h") == F.col("u"), "left").select("h", "n", F.coalesce("v", "h").alias("class"), F.posexplode("bands").alias("nth", "band"))
    shared = rows.groupBy("band").agg(F.min(F.struct("h", "n", "class")).alias("least"), F.max("h").alias("most"), F.count("*").alias("rows")).filter("least.h < most").select("band", "least", "rows")
    shared = materialize(shared, "bands")
    total = shared.agg(F.sum("rows")).first()[0] or 0
    met = salted_join(rows, shared.drop("rows"), "band", F.col("h"), total, MOST_MEETINGS, shared.select("band", F.col("rows").alias("n")))
    met = materialize(met.select("band", "nth", "h", "n", "class", F.col("least.h").alias("v"), F.col("least.n").alias("m"), F.col("least.class").alias("other")), "met")
    star = materialize(met.filter("h <> v AND class <> other").filter(_close("n", "m")).select(F.col("h").alias("u"), "v").distinct(), "star")
    first = known.union(_similar(star, docs, text_col))
    roots = components(first)
    of = met.join(roots, F.col("h") == F.col("u"), "left").select("band", "h", "n", F.coalesce("root", "h").alias("root"))
    parts = F.ceil(F.greatest(F.col("rows") / PART_ROWS, F.col("size") / PART_SHINGLES)).cast("int")
    apart = of.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("rows"), F.sum("n").alias("size")).filter("lo < hi").select("band", parts.alias("parts"))
    of = materialize(of.join(materialize(apart, "apart"), "band"), "of")
    leads = met.filter("h = v").groupBy("h").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("nth"))).alias("leads"))
    compared = nodes.select("h", "low", "keys").join(_sets(of.select("h"), docs, text_col), "h").join(leads, "h", "left").withColumn("leads", F.coalesce("leads", F.lit(0).cast("long")))
    own = F.pmod(F.xxhash64("h"), F.col("parts")).cast("int")
    dealt = (
        of.join(compared, "h")
        .withColumn("own", own)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("band", F.least("own", "with").alias("part"), F.greatest("own", "with").alias("other"), (F.col("own") != F.least("own", "with")).cast("int").alias("role"), "h", "n", "root", "leads", "low", "keys", "shingles")
    )
    parted = dealt.repartition("band", "part", "other").sortWithinPartitions("band", "part", "other", "role")
    return first.union(materialize(parted.mapInArrow(_compare, "u long, v long"), "rest"))


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of each component, with all its columns."""
    roots = components(links(docs, text_col))
    both = materialize(roots.union(roots.select("root", "root")).distinct(), "linked")
    rows = docs.select(F.col(id_col).alias("_id"), node(F.col(text_col)).alias("_h"))
    rows = materialize(rows.join(both, F.col("_h") == F.col("u")).select("_id", "_h", "root"), "linked_rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_h").alias("h"))).alias("best"))
    gone = rows.join(best, "root").filter(~(F.col("_id").eqNullSafe(F.col("best.id")) & (F.col("_h") == F.col("best.h")))).select("_id", "_h").distinct()
    gone = materialize(gone, "gone")
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (node(docs[text_col]) == gone["_h"]), "left_anti")
