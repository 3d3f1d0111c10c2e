"""BPE encoding and decoding through a distinct-word table.

Words are split inside Spark tasks; every chunk of documents sends only its
distinct words, hash-bucketed, to the encoding stage. A bucket's words pass in
slices of ``SLICE_BYTES``: a word that its slice or the worker's bounded table
of words already knows is not encoded again. The ids come back to the chunk and
are joined to the documents by position. Nothing is broadcast but the tokenizer
file, whose size is fixed, and no stage holds more than one chunk or one slice.

The words and the positions of a chunk are two reads of the same rows, so these
must come in the same order each time: a source that is not a table of files is
written once first.

Decoding joins ids to the pieces of the vocabulary (a fixed-size table).

Defined results: a null text is an empty one and gives no ids; an empty text
gives no ids; repeated rows give one row each; a null id column value is kept.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oppflow.llm.arrowtext import buffers, joined, lists, ragged, release, small_batches, string_view, units
from oppflow.shared import materialize

#: Bytes of text whose words share one word list.
CHUNK_BYTES = 10 << 20
#: Words in one call of the tokenizer.
_CALL = 2000
#: Positions of a chunk whose ids are put in order at a time.
_POSITIONS = 1 << 18
#: Buckets of words; their number only says how finely the work can be dealt.
BUCKETS = 128
#: Bytes of words encoded at a time.
SLICE_BYTES = 8 << 20
#: Words that each half of a worker process's table keeps the ids of, and their greatest length.
CACHE_WORDS, CACHE_LENGTH = 100_000, 64
_cache: dict[tuple[str, str], tuple[dict[str, bytes], dict[str, bytes]]] = {}


def public_path(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding; one for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def encode_words(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and the number of ids of each."""
    t, ids, count = tokenizer(path), [], np.zeros(len(words), np.int32)
    for k in range(0, len(words), _CALL):
        e = t.encode(words[k : k + _CALL], is_pretokenized=True, add_special_tokens=False)
        ids.append(np.array(e.ids, np.int32))
        count[k : k + _CALL] = np.bincount(np.array(e.word_ids, np.int64), minlength=len(words[k : k + _CALL]))
    return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), count


def known(path: str, words: list[str], encode=encode_words, size: int = CACHE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Like ``encode`` for different words, through the worker's bounded table.

    The table has a young and an old half; words that are met again are young.
    """
    young, old = _cache.setdefault((path, encode.__name__), ({}, {}))
    if len(young) + len(words) > size:
        young, old = _cache[path, encode.__name__] = ({}, young)
    new, long = [], {}
    for w in words:
        if w not in young:
            if (got := old.get(w)) is not None:
                young[w] = got
            else:
                new.append(w)
    if new:
        flat, lens = encode(path, new)
        body, ends, start = flat.astype("<u4").tobytes(), np.cumsum(lens) * 4, 0
        for w, e in zip(new, ends.tolist(), strict=True):
            (young if len(w) <= CACHE_LENGTH else long)[w] = body[start:e]
            start = e
    ids = [x if (x := young.get(w)) is not None else long[w] for w in words]
    if len(young) > 2 * size:  # one call brought more than the table may keep
        _cache[path, encode.__name__] = ({}, {})
    return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def _pack(x: np.ndarray) -> bytes:
    """An array's bytes, compressed, after their number."""
    raw = np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True), kind)


def _column(rows: list[bytes], kind) -> list[np.ndarray]:
    return [_unpack(b, kind) for b in rows]


def _chunk(batch: pa.RecordBatch) -> tuple[int, pa.Array, np.ndarray, np.ndarray]:
    """A hash of the chunk's word list, the list (most frequent first), word of each position, positions per document."""
    import xxhash

    word, count = units(batch.column(1))
    coded = word.dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(-np.bincount(at, minlength=len(coded.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    listed = coded.dictionary.take(pa.array(order))
    h = xxhash.xxh64(seed=len(listed))
    for buf in listed.buffers()[1:]:
        h.update(memoryview(buf) if buf is not None else b"")
    return h.intdigest() - (1 << 63), listed, rank[at], count


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, chunk_bytes: int = CHUNK_BYTES, of_files: bool = False, decoded: bool = False) -> DataFrame:
    """``id_col`` and ``ids array<int>`` of every row of ``docs``, as the tokenizer at ``path`` encodes whole texts.

    ``of_files``: ``docs`` is a table of files, whose rows come in the same order whenever a task reads them.
    ``decoded``: add what :func:`decode` does, in the same Python worker.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not of_files:
        src = materialize(src, "texts")
    id_type = src.schema["id"].dataType

    def placed(batches):
        """The chunks of a task and their names: places in the input, so that chunks with equal word lists stay apart. The
        list's hash is compared where a chunk meets its words: another list at that place is an error, not another result."""
        base = TaskContext.get().partitionId() << 32
        return ((base + k, b) for k, b in enumerate(joined(batches, chunk_bytes)))

    def split_words(batches):
        for place, b in placed(batches):
            name, listed, _, _ = _chunk(b)
            raw = listed.cast(pa.binary())
            to = np.fromiter(map(crc32, raw.to_pylist()), np.int64, len(raw)) % buckets
            order = np.argsort(to, kind="stable")  # a bucket's words stay in the list's order
            some, start = np.unique(to[order], return_index=True)
            offsets, body = buffers(raw.take(pa.array(order)))
            cut = np.append(start, len(order))
            rows = [(_pack(body[offsets[s] : offsets[e]]), _pack(np.diff(offsets[s : e + 1]).astype("<u4")), _pack(np.diff(order[s:e], prepend=0).astype("<u4"))) for s, e in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), place)), pa.array(np.full(len(some), name)), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(3)]], ["bucket", "chunk", "list", "words", "sizes", "places"])
            del listed, raw, order, offsets, body, rows
            release()

    def encode_slice(rows: list[tuple]) -> pa.RecordBatch:
        place, name, packed, size, places = zip(*rows, strict=True)
        sizes = _column(size, "<u4")
        body = np.concatenate(_column(packed, np.uint8))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
        coded = string_view(offsets, body).dictionary_encode()
        flat, lens = known(path, coded.dictionary.to_pylist())
        ids, n = ragged(lens, coded.indices.to_numpy(zero_copy_only=False), flat.astype("<u4"))
        cut = np.cumsum([0, *map(len, sizes)])
        at = np.concatenate([[0], np.cumsum(n)])[cut]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(place, pa.int64()),
                pa.array(name, pa.int64()),
                pa.array(places, pa.binary()),
                pa.array([_pack(n[s:e].astype("<u4")) for s, e in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                pa.array([_pack(ids[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary()),
            ],
            ["chunk", "list", "places", "lens", "ids"],
        )

    def encode_bucket(batches):
        rows, size = [], 0
        for b in batches:
            for row in zip(*[b[c] for c in ("chunk", "list", "words", "sizes", "places")], strict=True):
                row = tuple(x.as_py() for x in row)
                rows.append(row)
                size += int.from_bytes(row[2][:8], "little")
                if size >= SLICE_BYTES:
                    yield encode_slice(rows)
                    rows, size = [], 0
                    release()
        if rows:
            yield encode_slice(rows)
        _cache.clear()  # other buckets have other words
        release()

    def positions(batches):
        for place, b in placed(batches):
            name, _, at, count = _chunk(b)
            yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([name]), lists(b.column(0), [b.num_rows]), lists(pa.array(count.astype(np.int32)), [b.num_rows]), pa.array([_pack(at.astype("<u4"))], pa.binary())], ["chunk", "list", "id", "count", "at"])
            del at, count
            release()

    def join_back(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        at = np.concatenate(_column(left["at"].to_pylist(), "<u4"))
        order = np.concatenate([np.zeros(0, np.uint32), *[np.cumsum(p, dtype=np.uint32) for p in _column(right["places"].to_pylist(), "<u4")]])
        if len(at) and (not len(order) or at.max() >= len(order)):
            raise ValueError("a chunk lacks its word list")
        lens = np.concatenate([np.zeros(0, "<u4"), *_column(right["lens"].to_pylist(), "<u4")]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, "<u4"), *_column(right["ids"].to_pylist(), "<u4")])
        first = np.cumsum(lens, dtype=np.int32) - lens
        place = np.zeros(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        got, n_ids = [np.zeros(0, np.uint32)], np.zeros(len(at) + 1, np.int64)
        for s in range(0, len(at), _POSITIONS):
            pos = place[at[s : s + _POSITIONS]]
            n = lens[pos]
            ends = np.cumsum(n)
            got.append(flat[np.repeat(first[pos] - (ends - n), n) + np.arange(ends[-1])])
            n_ids[s + 1 : s + 1 + len(n)] = n
        del at, order, lens, flat, first, place
        ids = np.concatenate(got)
        count = left["count"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        per_doc = np.diff(np.cumsum(n_ids)[np.concatenate([[0], np.cumsum(count)])])
        out = {"id": left["id"].combine_chunks().flatten(), "ids": lists(pa.array(ids.astype(np.int32)), per_doc)}
        if decoded:
            pieces = piece_table(path)
            out["decoded"] = pa.array([t for k in range(0, len(out["ids"]), 500) for t in _texts(pieces, out["ids"].slice(k, 500))], pa.string())
        return pa.table(out)

    ints = T.ArrayType(T.IntegerType())
    words = src.mapInArrow(split_words, "bucket int, chunk long, list long, words binary, sizes binary, places binary")
    table = words.repartition("bucket").mapInArrow(encode_bucket, "chunk long, list long, places binary, lens binary, ids binary")
    at = src.mapInArrow(positions, T.StructType([T.StructField("chunk", T.LongType()), T.StructField("list", T.LongType()), T.StructField("id", T.ArrayType(id_type)), T.StructField("count", ints), T.StructField("at", T.BinaryType())]))
    out = at.groupBy("chunk", "list").cogroup(table.groupBy("chunk", "list")).applyInArrow(join_back, T.StructType([T.StructField("id", id_type), T.StructField("ids", ints), *([T.StructField("decoded", T.StringType())] if decoded else [])]))
    return out.withColumnRenamed("id", id_col)


@lru_cache(maxsize=4)
def piece_table(path: str) -> pa.Array:
    """Bytes of each id of a byte-level vocabulary; added tokens stand for themselves."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    byte_of = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    rows = {i: bytes(byte_of[c] for c in p) for p, i in j["model"]["vocab"].items()} | {a["id"]: a["content"].encode() for a in j["added_tokens"]}
    return pa.array([rows.get(i, b"") for i in range(max(rows) + 1)], pa.binary())


def _texts(pieces: pa.Array, ids: pa.ListArray) -> list[str]:
    """The joined pieces of each list of ids."""
    got = pieces.take(ids.flatten())
    offs = np.frombuffer(got.buffers()[1], np.int32)[got.offset : got.offset + len(got) + 1] if len(got) else np.zeros(1, np.int32)
    body = memoryview(got.buffers()[2]) if len(got) else b""
    cut = offs[ids.offsets.to_numpy(zero_copy_only=False) - ids.offsets[0].as_py()]
    return [bytes(body[s:e]).decode("utf-8", "replace") for s, e in zip(cut[:-1], cut[1:], strict=True)]


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Add ``decoded string``: the pieces of the ids, joined, as UTF-8 (invalid bytes become U+FFFD)."""
    cols = encoded.select(id_col, ids_col)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            pieces = piece_table(path)
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(_texts(pieces, part.column(1)), pa.string())], [id_col, ids_col, "decoded"])
            del b, part
            release()

    return cols.mapInArrow(run, T.StructType([*cols.schema.fields, T.StructField("decoded", T.StringType())]))


def digest(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of the query over a table of files: token count, hash of the ids, hash of the decoded text."""
    return encode(docs, path, chunk_bytes=chunk_bytes, of_files=True, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
