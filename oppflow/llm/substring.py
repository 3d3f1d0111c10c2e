"""Substring deduplication: windows of words that occur earlier are removed.

Every window of ``window`` words is routed by its minimizer (its least hashed
run of ``SEED_WORDS`` words), so equal windows always meet; consecutive windows
with one minimizer travel as one run. Hashes only route: a minimizer that stands
in one run alone cannot hold a repeated window, and its run is done. The words
of all other runs go to the shard of their minimizer. A shard is an FM-index
over the words of its different runs: a wavelet matrix over the Burrows-Wheeler
transform, bits packed, with rank counts and a suffix array sampled at every
``SAMPLED``-th word. The runs are streamed through it; backward search gives the
matching statistics of every position, and windows of full length whose earliest
occurrence is not their own are reported as intervals. So words decide, never
their hashes.

A minimizer that stands in more than ``WIDE_ROWS`` runs (a line that many
documents share, with different words around it) would be a shard without a
bound. Its runs are taken apart into windows, each routed by its own words and
settled as the stream passes: equal windows are neighbours there, and the first
one stays. No task holds such a group. Minimizers that a sample of documents
shows to be shared do not meet at all before that; whatever the sample misses is
found by its count. Both ways give the same result.

Copies are combined within each task before any shuffle, by their words, so a
passage that a third of all documents hold sends one run a task piece. A
document's text is shuffled once, and once more only if it has runs to look into.

Order is by document id, then position. Defined results: null and empty texts
have no words; ids may be of any type that sorts; equal rows are documents of
their own, the later one a copy (rows with equal ids are ordered by text, null
ids come last); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from oppflow.llm.arrowtext import _SPACE, pieces, release, small_batches, string_view, word_column, words
from oppflow.shared import freeing_shuffles, materialize

WINDOW = 20
#: Words of a minimizer.
SEED_WORDS = 10
#: Words of the runs that share one FM-index, about.
SHARD_WORDS = 400_000
#: Words between two kept entries of an index's suffix array.
SAMPLED = 16
#: Runs of one minimizer, from which on its windows travel alone.
WIDE_ROWS = 2000
#: Documents, about, in which widely shared minimizers are looked for early; a minimizer is one if it has so many different runs
#: there. What is missed is found by ``WIDE_ROWS``.
SAMPLE_DOCS, SHARED_RUNS, MOST_SHARED = 5000, 5, 10_000
_PIECE = 2 << 20
_BLOCK = 1 << 22
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every word."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = end - start
    first = np.cumsum(n) - n
    at = np.repeat(start - first, n) + np.arange(int(n.sum()))
    power = np.full(int(n.max()), _P, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    return _mix(np.add.reduceat((b[at].astype(np.uint64) + np.uint64(1)) * power[np.arange(len(at)) - np.repeat(first, n)], first) + n.astype(np.uint64))


def _grams(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash of the k words from each position on (fewer positions than words by k - 1)."""
    out = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        out = out * _P + h[j : j + len(out)]
    return _mix(out + np.uint64(seed))


def _least(g: np.ndarray, n: int) -> np.ndarray:
    """Position of the least of each n neighbours, the first of equals."""
    key = (g & ~np.uint64((1 << 24) - 1)) | np.arange(len(g), dtype=np.uint64)
    width, out = 1, key
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = n - width
    if rest:
        out = np.minimum(out[:-rest], out[rest:])
    return (out & np.uint64((1 << 24) - 1)).astype(np.int64)


def runs(h: np.ndarray, doc: np.ndarray, window: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer: minimizer, first word, number of windows. Words of one document are neighbours."""
    out = [[], [], []]
    for base in range(0, max(len(h) - window + 1, 0), _BLOCK):
        part = h[base : base + _BLOCK + window - 1]
        g = _grams(part, k, seed)
        pos = _least(g, window - k + 1)
        ok = doc[base : base + len(pos)] == doc[base + window - 1 : base + window - 1 + len(pos)]
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (pos[1:] != pos[:-1])
        s = np.flatnonzero(new)
        stop = np.flatnonzero(~ok)
        e = np.minimum(np.append(s[1:], len(pos)), np.append(stop, len(pos))[np.searchsorted(stop, s)])
        for x, y in zip(out, (g[pos[s]], s + base, e - s), strict=True):
            x.append(y)
    return tuple(np.concatenate([np.zeros(0, np.uint64 if k_ == 0 else np.int64), *x]) for k_, x in enumerate(out))


def run_hashes(h: np.ndarray, start: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """A hash of the words of each run, the same wherever the run stands."""
    p = np.full(len(h) + 1, _P, np.uint64)
    p[0] = 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(p[: len(h)]))])
    inv = np.full(len(h) + 1, _P_INV, np.uint64)
    inv[0] = 1
    inv = np.cumprod(inv)
    return _mix((total[start + n_words] - total[start]) * inv[start] + n_words.astype(np.uint64))


def copies(raw: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Marks the slices of ``raw`` that repeat an earlier one with the same key, byte for byte."""
    order = np.lexsort((np.arange(len(key)), end - start, key))
    k, n = key[order], (end - start)[order]
    head = np.ones(len(order), bool)
    head[1:] = (k[1:] != k[:-1]) | (n[1:] != n[:-1])
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    mine, of = order[~head], first[~head]
    out = np.zeros(len(order), bool)
    if len(mine):
        n = end[mine] - start[mine]
        base = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(base, n)
        same = raw[np.repeat(start[mine], n) + step] == raw[np.repeat(start[of], n) + step]
        out[mine] = np.logical_and.reduceat(same, base)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


class FMIndex:
    """Backward search over a sequence of small integers (0 separates runs), through a wavelet matrix of its BWT.

    Each separator is a symbol of its own within the index, smaller than all
    words, so suffixes differ before their runs end. Of the suffix array only
    every ``SAMPLED``-th position is kept; the others are found by LF steps.
    """

    def __init__(self, seq: np.ndarray) -> None:
        n = self.n = len(seq)
        apart = seq == 0
        self.runs = int(apart.sum())
        seq = np.where(apart, np.cumsum(apart) - 1, seq + (self.runs - 1))
        rank, depth, fresh = seq, 1, np.zeros(n, np.int64)
        sa = np.argsort(rank, kind="stable")
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[: n - depth] = rank[depth:] + 1
            pair = rank * (int(rank.max()) + 3) + nxt
            sa = np.argsort(pair, kind="stable")
            ordered = pair[sa]
            fresh[1:] = ordered[1:] != ordered[:-1]
            if int(fresh.sum()) >= n - 1:
                break
            rank = np.empty(n, np.int64)
            rank[sa] = np.cumsum(fresh)
            depth *= 2
        bwt = seq[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq))])
        self.levels = []
        for bit in range(max(int(seq.max()).bit_length(), 1) - 1, -1, -1):
            b = (bwt >> bit) & 1
            self.levels.append((bit, *self._packed(b), n - int(b.sum())))
            bwt = np.concatenate([bwt[b == 0], bwt[b == 1]])
        kept = sa % SAMPLED == 0
        self.kept = self._packed(kept)
        self.places = sa[kept].astype(np.uint32)

    @staticmethod
    def _packed(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits in words of 64, and how many ones stand before each word."""
        packed = np.zeros(len(b) // 64 + 2, np.uint64)
        raw = np.packbits(b.astype(np.uint8), bitorder="little")
        packed.view(np.uint8)[: len(raw)] = raw
        return packed, np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.uint32)

    @staticmethod
    def _ones(packed: np.ndarray, ones: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ones[at >> 6].astype(np.int64) + np.bitwise_count(packed[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    @staticmethod
    def _bit(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (packed[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol of c stands before place i of the BWT."""
        base = np.zeros_like(i)
        for bit, packed, ones, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            ri, rb = self._ones(packed, ones, i), self._ones(packed, ones, base)
            i = np.where(one, zeros + ri, i - ri)
            base = np.where(one, zeros + rb, base - rb)
        return i - base

    def back(self, i: np.ndarray) -> np.ndarray:
        """LF step: the row of the suffix that begins one symbol earlier."""
        base, c = np.zeros_like(i), np.zeros_like(i)
        for bit, packed, ones, zeros in self.levels:
            one = self._bit(packed, i)
            c |= one.astype(np.int64) << bit
            ri, rb = self._ones(packed, ones, i), self._ones(packed, ones, base)
            i = np.where(one, zeros + ri, i - ri)
            base = np.where(one, zeros + rb, base - rb)
        return self.before[c] + i - base

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array."""
        out, live, at = np.zeros(len(row), np.int64), np.arange(len(row)), row
        for step in range(SAMPLED):
            here = self._bit(self.kept[0], at)
            out[live[here]] = self.places[self._ones(*self.kept, at[here])].astype(np.int64) + step
            live, at = live[~here], at[~here]
            if not len(live):
                break
            at = self.back(at)
        return out

    @property
    def sa(self) -> np.ndarray:
        """The whole suffix array, by LF steps."""
        return self.locate(np.arange(self.n))

    def matching(self, seq: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the positions ``ends`` of ``seq``: how many symbols up to there occur twice or more in the index (``most`` at most), and the interval."""
        n = np.zeros(len(ends), np.int64)
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        live = np.arange(len(ends))
        for step in range(most):
            c = seq[ends[live] - step] + (self.runs - 1)
            a = self.before[c] + self.rank(c, lo[live])
            z = self.before[c] + self.rank(c, hi[live])
            more = (c >= self.runs) & (z - a > 1)
            live = live[more]
            lo[live], hi[live] = a[more], z[more]
            n[live] += 1
            if not len(live):
                break
        return n, lo, hi


def _repeated(texts: pa.Array, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of different runs in order of place: (run, window in it) of all windows that also stand in an earlier run."""
    b, start, end, size = words(texts)
    word = word_column(b, start, end).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(size + 1) - size - 1
    seq = np.zeros(int(size.sum()) + len(size), np.int64)
    seq[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(word))] = word + 1
    index = FMIndex(seq)
    run = np.repeat(np.arange(len(n)), n)
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = first[run] + nth
    length, lo, hi = index.matching(seq, at + window - 1, window)
    full = np.flatnonzero(length == window)
    if not len(full):
        return run[:0], nth[:0]
    some, back = np.unique(lo[full], return_inverse=True)
    top = np.zeros(len(some), np.int64)
    top[back] = hi[full]
    n_rows = top - some
    base = np.cumsum(n_rows) - n_rows
    found = index.locate(np.repeat(some - base, n_rows) + np.arange(int(n_rows.sum())))
    late = full[np.minimum.reduceat(found, base)[back] < at[full]]
    return run[late], nth[late]


def _groups(batches, least: int):
    """Tables of whole groups of ``seed`` (``WIDE_ROWS`` rows at most each) from sorted batches, of about ``least`` words."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += int((b["at"].to_numpy() & 31).sum()) + 19 * b.num_rows
        if size < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        k = t["seed"].to_numpy()
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut:
            yield t.slice(0, cut)
            t = t.slice(cut)
        held, size = t.to_batches(), int((t["at"].to_numpy() & 31).sum()) + 19 * t.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def ordered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, id, text``: ``doc`` is the id itself if ids are whole and unique, else a number in the order of ids."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if isinstance(src.schema["id"].dataType, T.IntegralType):
        with freeing_shuffles(docs.sparkSession):
            twice = src.groupBy("id").count().filter("count > 1 OR id IS NULL").limit(1).count()
        if not twice:
            return src.select(F.col("id").cast("long").alias("doc"), "id", "text")
    return materialize(src.orderBy(F.col("id").asc_nulls_last(), "text").select(F.monotonically_increasing_id().alias("doc"), "id", "text"), "ordered")


def shared_seeds(src: DataFrame, window: int) -> np.ndarray:
    """Minimizers with many different runs in a sample of ``src``, at most ``MOST_SHARED``."""

    def seeds(batches):
        for b in pieces(batches, _PIECE):
            data, start, end, count = words(b.column(0))
            h = word_hashes(data, start, end)
            m, s, n = runs(h, np.repeat(np.arange(len(count)), count), window, SEED_WORDS, 1)
            both = np.unique(np.stack([m, run_hashes(h, s, n + window - 1)]), axis=1)
            yield pa.RecordBatch.from_arrays([_signed(both[0]), _signed(both[1])], ["seed", "words"])

    share = min(1.0, SAMPLE_DOCS / max(src.count(), 1))
    some = src.filter(F.pmod(F.xxhash64("doc"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).select("text")
    counts = some.mapInArrow(seeds, "seed long, words long").distinct().groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") >= SHARED_RUNS)
    with freeing_shuffles(src.sparkSession):
        return np.array([r.seed for r in counts.orderBy(F.desc("n"), "seed").limit(MOST_SHARED).collect()], np.int64)


def removed_words(n_words: int, spans: list[int], window: int) -> np.ndarray:
    """Marks of the words that the spans (first word << 5 | windows) cover."""
    edge = np.zeros(n_words + 1, np.int64)
    s = np.array(spans, np.int64)
    np.add.at(edge, s >> 5, 1)
    np.add.at(edge, (s >> 5) + (s & 31) + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _settle(batches):
    """Of rows sorted by minimizer: what needs no look (kind 0: a copy), runs to compare (1), and runs whose windows travel alone (2).

    A run whose minimizer stands nowhere else is left out. At most ``WIDE_ROWS`` rows are held.
    """
    key, count, held = None, 0, []

    def out(doc: np.ndarray, at: np.ndarray, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at << 2 | kind)], ["doc", "span"])

    def close():
        if 1 < count <= WIDE_ROWS:
            yield out(np.concatenate([d for d, _ in held]), np.concatenate([a for _, a in held]), 1)

    for b in batches:
        k, doc, at = (c.to_numpy() for c in b.columns)
        known = at & 3
        for kind, mark in ((0, 0), (2, 3)):
            if (known == mark).any():
                yield out(doc[known == mark], at[known == mark] >> 2, kind)
        k, doc, at = k[known == 1], doc[known == 1], at[known == 1] >> 2
        if not len(k):
            continue
        cut = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        size = np.diff(cut)
        if k[0] != key:
            yield from close()
            key, count, held = k[0], 0, []
        for nth in {0, len(size) - 1}:  # the groups that other batches may share
            s, e = cut[nth], cut[nth + 1]
            if nth:
                yield from close()
                key, count, held = k[s], 0, []
                inner = np.repeat(size[1:-1], size[1:-1])
                for kind, mine in ((1, (inner > 1) & (inner <= WIDE_ROWS)), (2, inner > WIDE_ROWS)):
                    yield out(doc[cut[1] : s][mine], at[cut[1] : s][mine], kind)
            count += int(e - s)
            held.append((doc[s:e], at[s:e]))
            if count > WIDE_ROWS:
                for d, a in held:
                    yield out(d, a, 2)
                held = []
    yield from close()


def _spans(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single windows, sorted by document and first word, as spans of up to 31."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    cut = np.flatnonzero(new)
    d, s, n = doc[cut], start[cut], np.diff(np.append(cut, len(doc)))
    k = -(-n // 31)
    nth = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    s, n = np.repeat(s, k) + 31 * nth, np.repeat(n, k) - 31 * nth
    return np.repeat(d, k), s << 5 | np.minimum(n, 31)


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``id, n_words, n_removed, kept_text`` of every row, but with the SHA-256 of the kept text: ``kept_sha256``."""
    if not SEED_WORDS <= window <= SEED_WORDS + 30:
        raise ValueError(f"a window has {SEED_WORDS} to {SEED_WORDS + 30} words")
    small_batches(docs.sparkSession)
    src = ordered(docs, id_col, text_col)
    shared = shared_seeds(src, window)

    def make_runs(batches):
        for b in pieces(batches, _PIECE):
            data, start, end, count = words(b.column(1))
            h = word_hashes(data, start, end)
            row = np.repeat(np.arange(len(count)), count)
            m, s, n = runs(h, row, window, SEED_WORDS, 1)
            of = row[s]
            doc = b.column(0).to_numpy()[of]
            at = (s - (np.cumsum(count) - count)[of]) << 5 | n
            order = np.lexsort((at, doc))
            m, s, n, doc, at = (x[order] for x in (m, s, n, doc, at))
            # a later copy within this piece is settled, and a shared minimizer is known: both go anywhere
            copy = copies(data, start[s], end[s + n + window - 2], run_hashes(h, s, n + window - 1))
            wide = np.isin(m.view(np.int64), shared)
            key = np.where(copy | wide, _mix(doc.astype(np.uint64) * _P + at.astype(np.uint64)), m)
            yield pa.RecordBatch.from_arrays([_signed(key), _signed(doc), _signed(at << 2 | np.where(copy, 0, np.where(wide, 3, 1)))], ["seed", "doc", "at"])

    found = src.select("doc", "text").mapInArrow(make_runs, "seed long, doc long, at long").repartition("seed").sortWithinPartitions("seed").mapInArrow(_settle, "doc long, span long")
    per_doc = found.groupBy("doc").agg(F.collect_list("span").alias("spans"))
    with_spans = src.join(per_doc, "doc", "left").select("doc", "id", "text", "spans")

    def result(b: pa.RecordBatch, spans: list[list[int]]):
        """Word counts, removed words and hash of the kept words of every row."""
        data, start, end, count = words(b.column(b.schema.get_field_index("text")))
        first, raw = np.cumsum(count) - count, data.tobytes()
        gone, sha = [], []
        for f, n, s in zip(first.tolist(), count.tolist(), spans, strict=True):
            keep = np.arange(f, f + n)
            if s:
                keep = keep[~removed_words(n, s, window)]
            gone.append(n - len(keep))
            sha.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(start[keep].tolist(), end[keep].tolist(), strict=True)])).hexdigest())
        return pa.array(count.astype(np.int64)), pa.array(gone, pa.int64()), pa.array(sha, pa.string())

    id_type = src.schema["id"].dataType
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("id", id_type)] + [T.StructField(n, T.LongType()) for n in ("n_words", "n_removed", "doc", "seed", "at")] + [T.StructField("kept_sha256", T.StringType()), T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(T.LongType()))])
    fields = [(f.name, to_arrow_type(f.dataType)) for f in schema]

    def rows(n: int, kind: int, **cols):
        cols["kind"] = pa.array(np.full(n, kind, np.int32))
        return pa.RecordBatch.from_arrays([cols[f].cast(t) if f in cols else pa.nulls(n, t) for f, t in fields], [f for f, _ in fields])

    def with_words(batches):
        """Finished documents (kind 0), others with what is known of them (1), and the words of their runs (2) and single windows (3)."""
        for b in pieces(batches, _PIECE):
            spans = pc.fill_null(pc.list_value_length(b.column(3)), 0).to_numpy(zero_copy_only=False)
            flat = b.column(3).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), spans)
            look = np.zeros(b.num_rows, bool)
            look[row[flat & 3 > 0]] = True
            gone = [[] for _ in range(b.num_rows)]
            for r, s in zip(row[flat & 3 == 0].tolist(), (flat[flat & 3 == 0] >> 2).tolist(), strict=True):
                gone[r].append(s)
            done = b.filter(pa.array(~look))
            if done.num_rows:
                n_words, n_removed, sha = result(done, [g for g, k in zip(gone, look, strict=True) if not k])
                yield rows(done.num_rows, 0, id=done.column(1), n_words=n_words, n_removed=n_removed, kept_sha256=sha)
            if not look.any():
                continue
            data, start, end, count = words(b.column(2))
            base = np.cumsum(count) - count
            h = word_hashes(data, start, end)
            m, first, _ = runs(h, np.repeat(np.arange(len(count)), count), window, SEED_WORDS, 1)
            data = np.where(_SPACE[data], np.uint8(32), data)
            raw, doc_of = data.tobytes(), b.column(0).to_numpy()
            length = np.concatenate([[0], np.cumsum(end - start)])
            for kind in (1, 2):
                r, at = row[flat & 3 == kind], flat[flat & 3 == kind] >> 2
                if kind == 2:  # one row for each window
                    n = at & 31
                    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    r, at = np.repeat(r, n), (np.repeat(at >> 5, n) + nth) << 5 | 1
                order = np.lexsort((at, doc_of[r]))
                r, at = r[order], at[order]
                s = base[r] + (at >> 5)
                e = s + (at & 31) + window - 2
                plain = end[e] - start[s] == length[e + 1] - length[s] + e - s
                body = [raw[x:y] if p else b" ".join(raw[start[k] : end[k]] for k in range(f, t + 1)) for x, y, p, f, t in zip(start[s].tolist(), end[e].tolist(), plain.tolist(), s.tolist(), e.tolist(), strict=True)]
                offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, body), np.int64, len(body)))])
                text = string_view(offsets, np.frombuffer(b"".join(body), np.uint8))
                code = text.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                new = np.ones(len(code), bool)
                new[1:] = code[1:] > np.maximum.accumulate(code)[:-1] if len(code) else True
                for x, y in zip(r[~new].tolist(), at[~new].tolist(), strict=True):
                    gone[x].append(y)
                keep = np.flatnonzero(new)
                seed = m[np.searchsorted(first, s[keep])] if kind == 1 else np.zeros(len(keep), np.uint64)
                yield rows(len(keep), kind + 1, doc=_signed(doc_of[r[keep]]), at=_signed(at[keep]), seed=_signed(seed), text=text.take(pa.array(keep)))
            wait = b.filter(pa.array(look))
            yield rows(wait.num_rows, 1, doc=wait.column(0), id=wait.column(1), text=wait.column(2), spans=pa.array([g for g, k in zip(gone, look, strict=True) if k], pa.list_(pa.int64())))

    seen = materialize(with_spans.mapInArrow(with_words, schema), "runs")

    def search(batches):
        """Spans to remove of the runs of whole minimizers, through the shard's index."""
        for t in _groups(batches, SHARD_WORDS):
            doc, at = t["doc"].to_numpy(), t["at"].to_numpy()
            order = np.lexsort((at, doc))
            doc, at = doc[order], at[order]
            text = t["text"].combine_chunks().take(pa.array(order))
            code = text.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new = np.ones(len(code), bool)
            new[1:] = code[1:] > np.maximum.accumulate(code)[:-1]
            # a run equal to an earlier one: all its windows stand there
            yield pa.RecordBatch.from_arrays([pa.array(doc[~new]), pa.array(at[~new])], ["doc", "span"])
            doc, at = doc[new], at[new]
            run, nth = _repeated(text.filter(pa.array(new)), at & 31, window)
            d, span = _spans(doc[run], (at[run] >> 5) + nth)
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(span)], ["doc", "span"])
            del t, text, code
            release()

    def later(batches):
        """All but the first of equal windows, which are neighbours in order of place."""
        before = None
        for b in batches:
            if not b.num_rows:
                continue
            text = b.column(2)
            same = np.zeros(b.num_rows, bool)
            same[1:] = pc.equal(text.slice(1), text.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            same[0] = text[0].as_py() == before
            before = text[-1].as_py()
            yield b.select(["doc", "at"]).rename_columns(["doc", "span"]).filter(pa.array(same))

    compared = seen.filter("kind = 2").select("seed", "text", "doc", "at").repartition("seed").sortWithinPartitions("seed").mapInArrow(search, "doc long, span long")
    alone = seen.filter("kind = 3").select("doc", "at", "text").repartition("text").sortWithinPartitions("text", "doc", "at").mapInArrow(later, "doc long, span long")
    late = compared.union(alone).groupBy("doc").agg(F.collect_list("span").alias("late"))
    waiting = seen.filter("kind = 1").select("doc", "id", "text", "spans").join(late, "doc", "left")

    def finish(batches):
        for b in pieces(batches, _PIECE):
            spans = [(x or []) + (y or []) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), *result(b, spans)], ["id", "n_words", "n_removed", "kept_sha256"])

    cols = ["id", "n_words", "n_removed", "kept_sha256"]
    return seen.filter("kind = 0").select(cols).union(waiting.mapInArrow(finish, T.StructType([schema[c] for c in cols])))


def digest(docs: DataFrame) -> DataFrame:
    """Rows of the query."""
    return dedupe(docs).withColumnRenamed("id", "doc_id")
