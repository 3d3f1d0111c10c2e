"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text are its words (lower-cased), its word pairs, the shapes of
its words (runs of lower case, upper case and digits; marks as they are) and
pairs of shapes, hashed into 2^18 places; a feature's value is its share of the
text's features. Training takes a bounded sample of labelled rows in shards:
each shard runs its own updates and the shards' weights are averaged. Scoring
is a sparse dot product with a weight vector of fixed size. Labels other than 0
and 1 are skipped.

Defined results: null and wordless texts have no features but the bias and get
its score; a text with several labels is learned from with each; null labels
are skipped; repeated rows give a row each; with nothing to learn from every
score is 0.5; a null id is never held out; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oppflow.llm.arrowtext import pieces, small_batches, words
from oppflow.llm.langid import held_out

#: About so many labelled rows are learned from (chosen by a hash of their ids).
TRAIN_ROWS = 12_000
SHARDS = 6
EPOCHS = 4
#: Updates: step size, its smoothing, and the L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 1.0, 0.05, 0.0005, 0.0005
BITS = 18
#: From this score on a text counts as good.
GOOD = 0.7
_PIECE = 1 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123] = _CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), 0x100000001B3, np.uint64)
    p[0] = 1
    return np.cumprod(p)


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h + np.uint64(seed)) * _M1
    h ^= h >> np.uint64(29)
    return h * _M2


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of all features of all texts, text after text, and their number in each text."""
    b, start, end, count = words(texts)
    n = end - start
    if not len(n):
        return np.zeros(0, np.int64), np.zeros(len(count), np.int64)
    low = np.where((b >= 65) & (b <= 90), b + 32, b)
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    first = np.cumsum(n) - n
    power = _powers(int(n.max()))
    place = np.arange(len(at)) - np.repeat(first, n)
    word = np.add.reduceat((low[at].astype(np.uint64) + np.uint64(1)) * power[place], first)
    kind = _CLASS[b[at]]
    new = np.ones(len(at), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[first] = True
    run = np.cumsum(new) - 1
    place = run - np.repeat(run[first], n)
    shape = np.add.reduceat(np.where(new, (kind + np.uint64(1)) * power[place], np.uint64(0)), first)
    doc = np.repeat(np.arange(len(count)), count)
    same = doc[1:] == doc[:-1]
    out = np.empty((len(n), 4), np.int64)
    keep = np.ones((len(n), 4), bool)
    down = np.uint64(64 - BITS)
    for k, h in enumerate((word, shape)):
        out[:, 2 * k] = _mix(h, 11 + k) >> down
        out[:-1, 2 * k + 1] = _mix(_mix(h[:-1], 21 + k) + h[1:], 31 + k) >> down
        keep[:-1, 2 * k + 1] = same
        keep[-1, 2 * k + 1] = False
    return out[keep], np.bincount(doc, weights=keep.sum(axis=1), minlength=len(count)).astype(np.int64)


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights (the last one is the bias) after ``EPOCHS`` passes over (places, values, label)."""
    z = np.zeros((1 << BITS) + 1)
    n = np.zeros((1 << BITS) + 1)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, y in rows:
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(len(z)))


def learn(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from about ``rows`` rows of ``labels`` for which ``train`` (over the id) holds."""
    known = labels.filter(train & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    share = min(1.0, rows / max(known.count(), 1))
    chosen = known.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_003)) < int(share * 1_000_003)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    # the sample's size is a parameter, so its ids may be broadcast
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "label", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(7)), F.lit(SHARDS)).cast("int").alias("shard"), F.xxhash64(F.col("id").cast("string"), F.lit(8)).alias("order"))

    def train_shard(t: pa.Table) -> pa.Table:
        t = t.sort_by([("order", "ascending"), ("label", "ascending")]).combine_chunks()
        examples = []
        for b in t.to_batches(max_chunksize=200):
            at, count = features(b.column(0))
            ends = np.cumsum(count)
            for s, e, y in zip(ends - count, ends, b.column(1).to_pylist(), strict=True):
                some, c = np.unique(at[s:e], return_counts=True)
                examples.append((np.append(some, 1 << BITS), np.append(c / max(e - s, 1), 1.0), y))
        w = _ftrl(examples)
        some = np.flatnonzero(w)
        # place -1 counts the shards that had rows
        return pa.table({"at": pa.array(np.append(some, -1).astype(np.int32)), "w": pa.array(np.append(w[some], 1.0))})

    got = sample.groupBy("shard").applyInArrow(train_shard, "at int, w double").groupBy("at").agg(F.sum("w").alias("w")).toArrow()
    at, total = got["at"].to_numpy(), got["w"].to_numpy()
    w = np.zeros((1 << BITS) + 1, np.float32)
    w[at[at >= 0]] = total[at >= 0] / max(total[at < 0].sum(), 1.0)
    return w


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 1 MB, whatever the corpus

    def run(batches):
        w = shared.value
        for b in pieces(batches, _PIECE):
            at, count = features(b.column(1))
            total = np.concatenate([[0.0], np.cumsum(w[at], dtype=np.float64)])
            ends = np.cumsum(count)
            x = (total[ends] - total[ends - count]) / np.maximum(count, 1) + w[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(x, -35, 35))))], ["id", "score"])

    return src.mapInArrow(run, T.StructType([src.schema["id"], T.StructField("score", T.DoubleType())]))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the query: learned from the labels that are not held out, applied to all."""
    w = learn(docs, labels, ~held_out(F.col("doc_id"), 4, 2))
    return score(docs, w).select(F.col("id").alias("doc_id"), held_out(F.col("id"), 4, 2).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
