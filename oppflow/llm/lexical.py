"""Ranked lexical search by pipelined term partitioning.

Each term belongs to an owner, which holds its list of (document, integer
contribution); lists are cut by document shards, so a term that a third of all
documents hold is many bounded lists. Owners are passed in turn, from rare to
common terms. An item's bundle carries a sparse accumulator of documents and
scores; at each stage it meets the lists of one owner through a cogroup, adds
their contributions, and travels on. The best of every shard go to the final
selection, with document ids in place of positions.

A bundle lets a document go only once it cannot be among the best any more: its
score plus all that the owners still ahead can add in this shard, by the true
maxima of their lists, is below the ``top``-th score of the shard. What is
dropped so may come back at a later owner, with a part of its score, and still
cannot win. The result is that of scoring every document.

Items are taken in blocks of about ``BLOCK_ITEMS`` items and ``BLOCK_TERMS``
terms, whose vocabulary all tasks know; each block is one pass over all
documents. Texts are read once a block; what goes on is, for each document, its
length and the counts of the block's terms in it.

Defined results: null texts and texts without a term are no documents and score
nothing; an item without a term, or whose terms no document holds, has no rows;
every row is a document or an item of its own, repeated ids too; equal scores
go by ascending id, null ids last; equal ids by row; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oppflow.llm.arrowtext import pieces, release, small_batches
from oppflow.shared import materialize

#: Documents of a shard, about: an accumulator over one shard at its largest.
SHARD_DOCS = 8192
#: Items, and terms of items, of a block, about.
BLOCK_ITEMS, BLOCK_TERMS = 256, 200_000
#: Term owners, one stage each; about equally many list entries each.
OWNERS = 6
TOP = 10
#: Every ASCII character but letters and digits parts terms; A-Z become small.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Bytes of a text that are cut into terms at a time.
_CUT = 1 << 20


def count_terms(text: str | None, of: dict[bytes, int] | None = None) -> tuple[int, Counter]:
    """The number of terms, repeats included, and how often each one occurs (those of ``of`` only, by their number)."""
    body, n, at, counts = (text or "").encode().translate(_FOLD), 0, 0, Counter()
    while at < len(body):
        end = body.find(b" ", at + _CUT)
        end = len(body) if end < 0 else end
        words = body[at:end].split()
        n += len(words)
        counts.update(words if of is None else map(of.get, words))
        at = end
    counts.pop(None, None)
    return n, counts


def item_terms(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``item_row, item_id``, and ``item_row, term, times`` of every item."""
    rows = materialize(items.select(F.monotonically_increasing_id().alias("item_row"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text")), "items")

    def split(batches):
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                _, counts = count_terms(text.as_py())
                yield pa.record_batch([pa.array([row] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["item_row", "term", "times"])

    return rows.select("item_row", "item_id"), materialize(rows.select("item_row", "text").mapInArrow(split, "item_row long, term binary, times long"), "item-terms")


def forward(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``row_id, doc_id, n`` of every document with a term, and the ``terms`` of the vocabulary in it with their ``counts``."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"))
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def split(batches):
        of = known.value
        for b in pieces(batches, 4 << 20):
            n, size, terms, counts = [], [], [], []
            for text in b.column(0):
                total, found = count_terms(text.as_py(), of)
                n.append(total)
                size.append(len(found))
                terms.extend(found.keys())
                counts.extend(found.values())
            offsets = pa.array(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (counts, pa.int64()))]
            yield pa.record_batch([b.column(1), b.column(2), pa.array(n, pa.int64()), *lists], ["row_id", "doc_id", "n", "terms", "counts"])
            release()

    kind = docs.schema[id_col].dataType.simpleString()
    return materialize(src.mapInArrow(split, f"row_id long, doc_id {kind}, n long, terms array<int>, counts array<long>").filter("n > 0"), "forward")


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column without nulls."""
    return pc.list_value_length(lists).to_numpy().astype(np.int64), pc.list_flatten(lists).to_numpy()


def _owners(df: np.ndarray, owners: int) -> np.ndarray:
    """The owner of each term: rare terms first, with about equally many list entries for each owner."""
    order = np.argsort(df, kind="stable")
    upto = np.cumsum(df[order])
    out = np.zeros(len(df), np.int32)
    out[order] = np.minimum((upto - 1) * owners // max(1, upto[-1] if len(upto) else 1), owners - 1)
    return out


def inverted(shards: DataFrame, weights: np.ndarray, owner_of: np.ndarray, owners: int, n_docs: int, n_terms: int) -> DataFrame:
    """For each shard and owner its lists; owner -1 has the largest contribution of every term, owner -2 the ids by position.

    Positions are dealt in the order of the ids, so that ties go by position.
    """
    kind = shards.schema["doc_id"].dataType.simpleString()
    fixed = shards.sparkSession.sparkContext.broadcast((weights, owner_of))
    schema = f"shard long, owner int, ids array<{kind}>, terms array<int>, size array<int>, at array<int>, part array<long>"

    def build(key, table):
        weight, owner = fixed.value
        table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("row_id", "ascending")], null_placement="at_end")).combine_chunks()
        n = table["n"].to_numpy().astype(np.int64)
        m = 100 - 75 + (75 * n * n_docs) // n_terms
        size, terms = _flat(table["terms"])
        tf = _flat(table["counts"])[1].astype(np.int64)
        at = np.repeat(np.arange(len(n), dtype=np.int32), size)
        part = (1_000_000_000 * tf) // (1000 * tf + 8 * m[at])
        order = np.lexsort((at, terms, owner[terms]))
        terms, at, part = terms[order], at[order], part[order]
        starts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
        each, sizes = terms[starts], np.diff(np.concatenate([starts, [len(terms)]])).astype(np.int32)
        most = np.maximum.reduceat(part, starts) * weight[each] if len(starts) else part
        rows = [(-2, table["doc_id"].to_pylist(), None, None, None, None), (-1, None, each, None, None, most)]
        mine, entry = owner[each], owner[terms]
        for k in range(owners):
            here, lists = mine == k, entry == k
            if here.any():
                rows.append((k, None, each[here], sizes[here], at[lists], part[lists]))
        shard = key[0].as_py()
        columns = [pa.array([shard] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32())]
        kinds = [pa.list_(table["doc_id"].type), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        columns += [pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds)]
        return pa.table(columns, ["shard", "owner", "ids", "terms", "size", "at", "part"])

    return materialize(shards.groupBy("shard").applyInArrow(build, schema), "lists")


BUNDLE = "shard long, item_row long, ahead array<long>, docs array<int>, scores array<long>"


def _bundles(shard: int, rows: list[tuple]) -> pa.Table:
    """Rows of (item, most that each owner can add, positions, scores)."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
    return pa.table([pa.array([shard] * len(rows), pa.int64()), *columns], ["shard", "item_row", "ahead", "docs", "scores"])


def added(docs: np.ndarray, scores: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray, int]], ahead: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The accumulator with the contributions of an owner's lists (positions, contributions, factor), without documents that cannot win."""
    size = 1 + max([int(docs[-1]) if len(docs) else -1, *(int(at[-1]) for at, _, _ in lists)])
    if size == 0:
        return docs, scores
    acc = np.zeros(size, np.int64)
    acc[docs] = scores
    for at, part, factor in lists:
        acc[at] += part * factor
    found = np.flatnonzero(acc)
    scores = acc[found]
    if len(found) > top:
        least = np.partition(scores, len(scores) - top)[len(scores) - top]
        stays = scores + ahead >= least
        found, scores = found[stays], scores[stays]
    return found.astype(np.int32), scores


def search_block(docs: DataFrame, wanted: list[tuple[int, bytes, int]], top: int, id_col: str, text_col: str, shard_docs: int, owners: int) -> DataFrame | None:
    """``item_row, doc_id, score`` of the best of every shard for the (item, term, times) of one block."""
    spark = docs.sparkSession
    vocabulary = {t: k for k, t in enumerate(sorted({t for _, t, _ in wanted}))}
    rows = forward(docs, vocabulary, id_col, text_col)
    n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the vocabulary of the block
        df[r[0]] = r[1]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    owner_of = _owners(df, owners)
    shard = F.pmod(F.xxhash64("row_id"), F.lit(-(-n_docs // shard_docs)))
    lists = inverted(rows.withColumn("shard", shard), weights, owner_of, owners, n_docs, n_terms)
    of: dict[int, list[tuple[int, int]]] = {}
    for item, term, times in wanted:
        of.setdefault(item, []).append((vocabulary[term], times))
    block = spark.sparkContext.broadcast((of, weights, owner_of))

    def start(key, table):
        of, _, owner = block.value
        most = dict(zip(table["terms"][0].as_py(), table["part"][0].as_py(), strict=True))
        out = []
        for item, terms in of.items():
            ahead = [0] * owners
            for t, times in terms:
                ahead[owner[t]] += most.get(t, 0) * times
            if any(ahead):
                out.append((item, ahead, [], []))
        return _bundles(key[0].as_py(), out)

    def stage(k: int):
        def meet(key, bundles, owned):
            of, weight, owner = block.value
            held = {}
            if owned.num_rows:
                terms, size, at, part = (owned[c][0].values.to_numpy() for c in ("terms", "size", "at", "part"))
                held = {t: (at[e - s : e], part[e - s : e]) for t, s, e in zip(terms.tolist(), size.tolist(), np.cumsum(size).tolist(), strict=True)}
            out = []
            for item, ahead, seen, scores in zip(*(bundles[c] for c in ("item_row", "ahead", "docs", "scores")), strict=True):
                item, ahead = item.as_py(), ahead.as_py()
                lists = [(*held[t], times * int(weight[t])) for t, times in of[item] if owner[t] == k and t in held]
                got = added(seen.values.to_numpy(), scores.values.to_numpy(), lists, sum(ahead[k + 1 :]), top)
                out.append((item, ahead, *got))
            return _bundles(key[0].as_py(), out)

        return meet

    def best(key, bundles, ids):
        named, out = ids["ids"][0].values, []
        for item, seen, scores in zip(bundles["item_row"], bundles["docs"], bundles["scores"], strict=True):
            seen, scores = seen.values.to_numpy(), scores.values.to_numpy()
            first = np.lexsort((seen, -scores))[:top]
            out.append(pa.table([pa.array([item.as_py()] * len(first), pa.int64()), named.take(pa.array(seen[first])), pa.array(scores[first])], ["item_row", "doc_id", "score"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64()), pa.array([], named.type), pa.array([], pa.int64())], ["item_row", "doc_id", "score"])

    owned = lambda k, *cols: lists.filter(F.col("owner") == k).select("shard", *cols)
    bundles = owned(-1, "terms", "part").groupBy("shard").applyInArrow(start, BUNDLE)
    for k in range(owners):
        bundles = bundles.groupBy("shard").cogroup(owned(k, "terms", "size", "at", "part").groupBy("shard")).applyInArrow(stage(k), BUNDLE)
    kind = docs.schema[id_col].dataType.simpleString()
    ends = bundles.groupBy("shard").cogroup(owned(-2, "ids").groupBy("shard")).applyInArrow(best, f"item_row long, doc_id {kind}, score long")
    return materialize(ends, "best")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shard_docs: int = SHARD_DOCS, block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS, owners: int = OWNERS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` documents with the highest scores above 0."""
    spark = docs.sparkSession
    rows, terms = item_terms(items, item_id_col, item_text_col)
    n_items, n_pairs = terms.agg(F.countDistinct("item_row"), F.count("*")).first()
    blocks = max(-(-n_items // block_items), -(-n_pairs // block_terms))
    found = []
    for b in range(blocks):
        mine = terms.filter(F.pmod(F.xxhash64("item_row"), F.lit(blocks)) == b) if blocks > 1 else terms
        wanted = [(r.item_row, bytes(r.term), r.times) for r in mine.collect()]  # one block
        got = search_block(docs, wanted, top, id_col, text_col, shard_docs, owners) if wanted else None
        if got is not None:
            found.append(got)
    kind = docs.schema[id_col].dataType.simpleString()
    out = reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], f"item_row long, doc_id {kind}, score long")
    by_score = Window.partitionBy("item_row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= top)
    return ranked.join(rows, "item_row").select("item_id", "rank", "doc_id", "score")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of the query."""
    return search(docs, items)
