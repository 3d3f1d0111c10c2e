"""Language identification of mixed-language text.

A word's script (the range of its first letter) narrows the candidate
languages; letter trigrams score the word in each candidate; Viterbi over the
words of a document, with a penalty for each switch of language, labels spans.
The model is fixed in size: a table of hashed byte trigrams and a table of
scripts for each language, learned from a bounded sample of labelled rows.

Defined results: null text and text without a letter are ``und`` with score 0;
any other text gets a learned language, even in a script that was never seen
(then the most frequent one, score 0); ``und`` also if nothing was learned; ties
go to the language that sorts first; repeated rows give a row each; a null id is
never held out; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oppflow.llm.arrowtext import buffers, lists, pieces, release, small_batches

#: About so many labelled rows are learned from (chosen by a hash of their ids, or texts where there is no id).
TRAIN_ROWS = 8000
#: What a change of language costs, in nats.
SWITCH = 6.0
#: Most nats by which one word can speak against a language.
CLIP = 6.0
#: A script is a language's own if at least this share of its words begins in it.
SCRIPT_SHARE = 0.005
_BITS = 16
_PIECE = 4 << 20
_PART = 1 << 20
#: First code points of script ranges: Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Indic, Thai and Lao, Tibetan, Burmese,
#: Georgian, Hangul jamo, Ethiopic and others, Latin (extended), symbols, kana, Han, Hangul, others.
_SCRIPTS = np.array([0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xE00, 0xF00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x2000, 0x3040, 0x3100, 0xAC00, 0xD7B0])
_SCRIPT_NAMES = len(_SCRIPTS)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(0x80, 0x100)]] = True


def held_out(c: Column, parts: int = 3, rest: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``rest``."""
    return F.coalesce(F.crc32(c.cast("string")) % parts == rest, F.lit(False))


def _words(texts: pa.Array):
    """Trigram of every letter byte, first byte of every word, script and size of every word, words per text.

    A word is a run of letters (ASCII letters and all bytes beyond ASCII), lower-cased.
    """
    offsets, b = buffers(pc.utf8_lower(texts))
    is_letter = np.zeros(len(b) + 2, bool)
    is_letter[1:-1] = _LETTER[b]
    cut = np.zeros(len(b) + 1, bool)
    cut[offsets] = True
    begin = is_letter[1:] & (~is_letter[:-1] | cut)
    stop = is_letter[:-1] & (~is_letter[1:] | cut)
    start, end = np.flatnonzero(begin), np.flatnonzero(stop)
    x = b.astype(np.uint32)
    prev = np.zeros(len(b), np.uint32)
    nxt = np.zeros(len(b), np.uint32)
    prev[1:], nxt[:-1] = x[:-1], x[1:]
    prev[start], nxt[end - 1] = 32, 32
    at = np.flatnonzero(is_letter[1:-1])
    tri = ((prev[at] * np.uint32(65537) + x[at] * np.uint32(257) + nxt[at]) * np.uint32(2654435761)) >> np.uint32(32 - _BITS)
    size = end - start
    first = np.cumsum(size) - size
    pad = np.concatenate([x, np.zeros(3, np.uint32)])
    b0, b1, b2 = pad[start], pad[start + 1] & 63, pad[start + 2] & 63
    cp = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 31) << 6 | b1, np.where(b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, 0x20000)))
    script = np.searchsorted(_SCRIPTS, cp, "right") - 1
    script[script == 13] = 0
    return tri, first, script, size, np.diff(np.searchsorted(start, offsets))


def learn(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> dict:
    """The model from about ``rows`` rows of ``docs`` for which ``train`` holds and text and language are not null."""
    small_batches(docs.sparkSession)
    labelled = docs.filter(train & F.col(lang_col).isNotNull())
    share = min(1.0, rows / max(labelled.count(), 1))
    by = F.coalesce(F.col(id_col).cast("string"), F.col(text_col))
    chosen = labelled.filter((F.pmod(F.xxhash64(by), F.lit(1_000_003)) < int(share * 1_000_003)) & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in pieces(batches, _PART):
            langs = b.column(0).to_pylist()
            tri, first, script, size, n_words = _words(b.column(1))
            of_word = np.repeat(np.arange(len(langs)), n_words)
            of_tri = np.repeat(of_word, size)
            names = sorted(set(langs))
            k = np.array([names.index(x) for x in langs])
            for j, name in enumerate(names):
                c = total.setdefault(name, np.zeros((1 << _BITS) + _SCRIPT_NAMES, np.int64))
                c[: 1 << _BITS] += np.bincount(tri[k[of_tri] == j], minlength=1 << _BITS)
                c[1 << _BITS :] += np.bincount(script[k[of_word] == j], minlength=_SCRIPT_NAMES)
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "at", "n"])

    got = chosen.mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    counts = np.zeros((len(langs), (1 << _BITS) + _SCRIPT_NAMES))
    place = {x: k for k, x in enumerate(langs)}
    if langs:
        counts[[place[x] for x in got["lang"].to_pylist()], got["at"].to_numpy()] = got["n"].to_numpy()
    tri, scripts = counts[:, : 1 << _BITS], counts[:, 1 << _BITS :]
    log = np.log((tri + 0.1) / (tri.sum(axis=1, keepdims=True) + 0.1 * (1 << _BITS))) if langs else tri
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return {"langs": langs, "log": np.ascontiguousarray(log.T, np.float32), "allowed": np.ascontiguousarray(allowed.T), "common": int(scripts.sum(axis=1).argmax()) if langs else 0}


def word_scores(model: dict, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score of every word in every language (0 for the best, ``-CLIP`` at least), whether any is a candidate, sizes, words per text."""
    tri, first, script, size, n_words = _words(texts)
    if not len(first) or not model["langs"]:
        return np.zeros((len(first), len(model["langs"])), np.float32), np.zeros(len(first), bool), size, n_words
    s = np.add.reduceat(model["log"][tri], first, axis=0)
    ok = model["allowed"][script]
    s[~ok] = -np.inf
    some = ok.any(axis=1)
    s[~some] = 0
    s -= s.max(axis=1, keepdims=True)
    return np.maximum(s, -CLIP, out=s), some, size, n_words


def viterbi(scores: np.ndarray, n_words: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word; all texts step together, the longest first."""
    n_langs = scores.shape[1]
    path = np.zeros(len(scores), np.uint8 if n_langs < 256 else np.uint16)
    if not len(scores):
        return path
    order = np.argsort(-n_words, kind="stable")
    length = n_words[order]
    first = (np.cumsum(n_words) - n_words)[order]
    active = np.searchsorted(-length, -np.arange(length[0]), "left")
    stay = np.zeros((len(scores), n_langs), bool)  # False: came from the best of the word before
    best_from = np.zeros(len(scores), path.dtype)
    v = scores[first[: active[0]]]
    last = np.zeros(len(order), path.dtype)
    for t in range(1, length[0]):
        k = active[t]
        if k < len(v):
            last[k : len(v)] = v[k:].argmax(axis=1)
            v = v[:k]
        at = first[:k] + t
        arg = v.argmax(axis=1)
        jump = v[np.arange(k), arg][:, None] - switch
        keep = v >= jump
        stay[at], best_from[at] = keep, arg
        v = np.where(keep, v, jump) + scores[at]
    last[: len(v)] = v.argmax(axis=1)
    state = last
    for t in range(length[0] - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        now = state[:k]
        path[at] = now
        if t:
            state[:k] = np.where(stay[at, now], now, best_from[at])
    return path


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """``id, lang_pred, score, spans``: spans are runs of words (``lang``, first word, end word)."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(model)  # 2^16 rows for each language, however large the corpus

    def run(batches):
        model = shared.value
        langs = np.array([*model["langs"], "und"], object)
        n_langs = len(langs) - 1
        for b in pieces(batches, _PIECE):
            texts = b.column(1)
            got = [word_scores(model, p.column(1)) for p in pieces([b], _PART)]
            scores, some, size, n_words = (np.concatenate([g[k] for g in got]) for k in range(4))
            letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            path = viterbi(scores, n_words, switch) if n_langs else np.zeros(len(size), np.uint8)
            doc = np.repeat(np.arange(len(n_words)), n_words)
            votes = np.bincount(doc * max(n_langs, 1) + path, weights=size * some, minlength=len(n_words) * max(n_langs, 1)).reshape(len(n_words), -1)
            total, best = votes.sum(axis=1), votes.argmax(axis=1)
            known = letter & (n_langs > 0)
            seen = known & (total > 0)
            pred = np.where(seen, best, np.where(known, model["common"], n_langs))
            score = np.where(seen, votes.max(axis=1) / np.maximum(total, 1), 0.0)
            change = np.ones(len(path), bool)
            change[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
            start = np.flatnonzero(change)
            end = np.append(start[1:], len(path))
            base = (np.cumsum(n_words) - n_words)[doc[start]] if len(start) else start
            spans = pa.StructArray.from_arrays([pa.array(langs[path[start]] if n_langs else np.full(len(start), "und", object), pa.string()), pa.array((start - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], ["lang", "start", "end"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs[pred], pa.string()), pa.array(score), lists(spans, np.bincount(doc[start], minlength=len(n_words)))], ["id", "lang_pred", "score", "spans"])
            del got, scores, path, doc, spans
            release()

    span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return src.mapInArrow(run, T.StructType([src.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))]))


def digest(docs: DataFrame) -> DataFrame:
    """Rows of the query: learned from the rows that are not held out, applied to all."""
    model = learn(docs, ~held_out(F.col("doc_id")))
    return identify(docs, model).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
