"""Token-id files: flat little-endian unsigned integers with 64-bit document offsets.

One shard is a range of ids in ascending order. A shard is two files:

* ``shard-00007.bin``: the ids of its documents one after the other, as uint16
  where the vocabulary allows it, else uint32;
* ``shard-00007.idx``: int64 values: the number of documents n, the bytes of an
  id, the shard's base (ids in all shards before it), n document ids, and n + 1
  offsets into the whole sequence; then n bytes, 1 where a document id is null.

The ids are encoded and written by shard; the bases are prefix sums over one
row per shard; then the index files are written. Files are written under another
name and renamed, and hold the same bytes however often a task runs, so lost
executors and repeated tasks do no harm. Reading maps a file into memory.

Document ids are whole numbers, as the index holds them as 64-bit values; others
are refused. Defined results: a null text is an empty one (only the end id);
rows with a null document id come first; rows with equal ids are ordered by
text; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oppflow.llm.arrowtext import joined, lists, ragged, release, small_batches, units
from oppflow.llm.bpe import encode_words, known, tokenizer
from oppflow.shared import new_path

#: Words that each half of a worker process's table keeps the ids of.
CACHE_WORDS = 450_000
#: Bytes of text encoded at a time.
PIECE_BYTES = 8 << 20
#: What a unit must not hold to be plain: letters beyond ASCII and composed Latin ones, and special tokens. The pieces of plain
#: units, in lower case, do not depend on what stands beside them; a line end ends a unit.
_ODD = "[^\\x00-\\x7FÀ-ÖØ-öø-ÿ]|<\\|"
_PLAIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|\n|[^ \t\n\x0b\x0c\ra-z\xdf-\xf6\xf8-\xff0-9]+")


def _store(where: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(where)
    return store, path


def _write(where: str, name: str, parts: Iterable[bytes]) -> None:
    """Write bytes, as they come, under a name of this attempt's own, then move them to ``name``."""
    import uuid

    store, path = _store(where)
    store.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        for p in parts:
            out.write(p)
    store.move(own, f"{path}/{name}")


def _encode_plain(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Like encode_words for words that are one piece each to the tokenizer: in one call, cut after the ids that end a word."""
    t = tokenizer(path)
    ids = np.array(t.encode(" ".join(words), add_special_tokens=False).ids, np.int32)
    last = np.flatnonzero(_ends(path)[ids])
    if len(last) != len(words):
        return encode_words(path, words)
    return ids, np.diff(last, prepend=-1)


@lru_cache(maxsize=2)
def _ends(path: str) -> np.ndarray:
    """Which ids end a word."""
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
    return out


def _plain_ids(path: str, units_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of units whose pieces do not depend on each other, through the distinct pieces of all of them."""
    if not len(units_):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    piece = pa.array(_PLAIN.findall("\n".join(pc.utf8_lower(units_).to_pylist()) + "\n"), pa.string()).dictionary_encode()
    listed = piece.dictionary.to_pylist()
    at = piece.indices.to_numpy(zero_copy_only=False)
    end = listed.index("\n")
    flat, lens = known(path, [w for w in listed if w != "\n"], _encode_plain, CACHE_WORDS)
    lens = np.insert(lens, end, 0)
    ids, n = ragged(lens, at, flat)
    return ids, np.diff(np.cumsum(n)[at == end], prepend=0)


def encode_texts(path: str, texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, and the number of ids of each; every distinct word goes to the tokenizer once.

    ``lower``: the vocabulary drops white space and lower-cases, so plain
    words can share the ids of their lower-cased pieces.
    """
    word, count = units(texts)
    coded = word.dictionary_encode()
    distinct = coded.dictionary
    if lower:
        distinct = pc.utf8_trim(distinct, characters=" \t\n\x0b\x0c\r")
        odd = pc.match_substring_regex(distinct, _ODD).to_numpy(zero_copy_only=False)
    else:
        odd = np.ones(len(distinct), bool)
    plain, plain_n = _plain_ids(path, distinct.filter(pa.array(~odd)))
    rest, rest_n = known(path, distinct.filter(pa.array(odd)).to_pylist(), encode_words, CACHE_WORDS)
    lens = np.zeros(len(distinct), np.int64)
    start = np.zeros(len(distinct), np.int64)
    for mine, n, base in ((~odd, plain_n, 0), (odd, rest_n, len(plain))):
        lens[mine] = n
        start[mine] = base + np.cumsum(n) - n
    at = coded.indices.to_numpy(zero_copy_only=False)
    n = lens[at]
    ends = np.cumsum(n)
    got = np.concatenate([plain, rest])[np.repeat(start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    return got, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])])


def write(docs: DataFrame, path: str, end_id: int, out: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_rows: int | None = None) -> tuple[str, int]:
    """Encode all texts with the tokenizer at ``path``, append ``end_id``, write the files; the folder and the number of shards.

    Shards are ranges of about equally many rows, from quantiles of the id column alone.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"document ids must be whole numbers, and {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    where = out or new_path(spark, "tokens")
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    n_shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if shard_rows:
        n_shards = max(1, -(-ids.count() // shard_rows))
    cuts = sorted(set(ids.filter("id is not null").approxQuantile("id", [k / n_shards for k in range(1, n_shards)], 0.1 / n_shards))) if n_shards > 1 else []
    cuts = [int(c) for c in cuts]
    shard = F.when(F.col("id").isNull(), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("id"))) if cuts else F.lit(0)).cast("int")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = len(cuts) + 1
    ranged = src.withColumn("shard", shard).repartitionById(n, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "text")

    def encode_shard(batches):
        t = tokenizer(path)
        wide = max(t.get_vocab_size(with_added_tokens=True) - 1, end_id) >= 1 << 16
        lower = '"Lowercase"' in t.to_str()[:4000] if t.normalizer is not None else False
        kind, doc, no_id, lens = "<u4" if wide else "<u2", [], [], []

        def encoded(parts):
            for b in parts:
                got, count = encode_texts(path, b.column(1), lower)
                yield np.insert(got, np.cumsum(count), end_id).astype(kind).tobytes()
                lens.append(count + 1)
                doc.append(pc.fill_null(b.column(0), 0).to_numpy(zero_copy_only=False))
                no_id.append(pc.is_null(b.column(0)).to_numpy(zero_copy_only=False))
                release()

        parts = joined(batches, PIECE_BYTES)
        first = next(parts, None)
        if first is not None:  # a task holds one shard, and of its ids one piece at a time
            at = first.column(2)[0].as_py()
            _write(where, f"shard-{at:05d}.bin", encoded(chain([first], parts)))
            offs = np.concatenate([[0], np.cumsum(np.concatenate(lens))]).astype("<i8")
            ids_, nulls = np.concatenate(doc).astype("<i8"), np.concatenate(no_id)
            _write(where, f"shard-{at:05d}.part", [np.array([len(ids_), np.dtype(kind).itemsize], "<i8").tobytes(), ids_.tobytes(), offs.tobytes(), nulls.astype(np.uint8).tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([int(offs[-1])], pa.int64())], ["shard", "n"])

    # one row per shard: its number of ids
    total = {r.shard: r.n for r in ranged.mapInArrow(encode_shard, "shard int, n long").collect()}
    bases, base = [], 0
    for k in sorted(total):
        bases.append((k, base))
        base += total[k]

    def write_index(batches):
        for b in batches:
            for k, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, root = _store(where)
                raw = store.open_input_file(f"{root}/shard-{k:05d}.part").readall()
                n_docs, item = np.frombuffer(raw, "<i8", 2).tolist()
                offs = np.frombuffer(raw, "<i8", n_docs + 1, 16 + 8 * n_docs)
                _write(where, f"shard-{k:05d}.idx", [np.array([n_docs, item, at], "<i8").tobytes(), raw[16 : 16 + 8 * n_docs], (offs + at).astype("<i8").tobytes(), raw[24 + 16 * n_docs :]])
            yield b

    if bases:
        spark.createDataFrame(bases, "shard int, base long").repartition(min(len(bases), n), "shard").mapInArrow(write_index, "shard int, base long").write.format("noop").mode("overwrite").save()
    return where, len(bases)


def read_shard(where: str, k: int):
    """Document ids, null marks, offsets and ids of a shard, mapped into memory where the store is a local one."""
    store, root = _store(where)
    if isinstance(store, fs.LocalFileSystem):
        index, flat = (np.memmap(f"{root}/shard-{k:05d}.{x}", np.uint8, "r") for x in ("idx", "bin"))
    else:
        index, flat = (np.frombuffer(store.open_input_file(f"{root}/shard-{k:05d}.{x}").read_buffer(), np.uint8) for x in ("idx", "bin"))
    n, item, base = np.frombuffer(index[:24], "<i8").tolist()
    doc = np.frombuffer(index[24 : 24 + 8 * n], "<i8")
    offs = np.frombuffer(index[24 + 8 * n : 32 + 16 * n], "<i8")
    return doc, np.frombuffer(index[32 + 16 * n :], np.uint8), offs, flat.view(f"<u{item}"), base


def read(spark: SparkSession, where: str, n_shards: int, batch: int = 2000) -> DataFrame:
    """``doc_id, start, ids array<int>`` of all documents, from the files."""
    return _scan(spark, where, n_shards, batch, "doc_id long, start long, ids array<int>", lambda flat, offs: lists(pa.array(flat.astype(np.int32)), np.diff(offs)))


def _scan(spark: SparkSession, where: str, n_shards: int, batch: int, schema: str, of) -> DataFrame:
    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                doc, null, offs, flat, base = read_shard(where, name)
                for s in range(0, len(doc), batch):
                    e = min(s + batch, len(doc))
                    part = offs[s : e + 1] - base
                    got = of(flat[part[0] : part[-1]], part - part[0])
                    yield pa.RecordBatch.from_arrays([pa.array(doc[s:e], mask=null[s:e] > 0), pa.array(offs[s:e]), *(got if isinstance(got, tuple) else (got,))], [f.split()[0] for f in schema.split(", ")])

    if not n_shards:
        return spark.createDataFrame([], schema)
    store, root = _store(where)
    names = sorted(int(i.base_name[6:11]) for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".idx"))
    return spark.createDataFrame([(k,) for k in names], "shard int").repartition(len(names), "shard").mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Rows of the query, from the files that it has written."""

    def row(flat, offs):
        raw = flat.astype("<u4")
        return pa.array(np.diff(offs)), pa.array([crc32(raw[s:e]) for s, e in zip(offs[:-1], offs[1:], strict=True)], pa.int64())

    where, n = write(docs, path, end_id)
    return _scan(docs.sparkSession, where, n, 2000, "doc_id long, start long, n_tokens long, ids_crc32 long", row)
