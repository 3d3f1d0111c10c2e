"""Small helpers over Arrow string columns, used inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: The white space of the contracts: [\x20\x09-\x0D].
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Last bytes that a white-space character outside ASCII can have in UTF-8.
_MAYBE_SPACE_END = np.zeros(256, bool)
_MAYBE_SPACE_END[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True


#: Bytes of an Arrow batch of texts, about.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let the session send texts to Python in batches of about ``BATCH_BYTES``: each batch stands in memory on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back to the system; worker processes live on after a stage and share an executor's memory with the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0, int64) and bytes of a string column; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], body


def pieces(batches: Iterator[pa.RecordBatch], limit: int, text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of about ``limit`` bytes of text (a longer text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text_col))
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start, n = np.cumsum(size), 0, batch.num_rows
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def joined(batches: Iterator[pa.RecordBatch], limit: int, text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """Like :func:`pieces`, but small neighbours are put together up to ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in pieces(batches, limit, text_col):
        n = int(buffers(b.column(b.schema.get_field_index(text_col)))[0][-1])
        if held and size + n > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def string_view(offsets: np.ndarray, body: np.ndarray, kind: pa.DataType = pa.string()) -> pa.Array:
    """An Arrow column over ``body`` without a copy."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body))])


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Cut every text before each white-space run that follows a visible character.

    Returns the units of all texts in order and the number of units of each
    text. Concatenated, the units give the text again. No unit begins inside a
    run of (Unicode) white space, so a tokenizer that never looks across the
    end of a word gives the same ids for the units as for the text.
    """
    offsets, b = buffers(texts)
    begin = np.zeros(len(b) + 1, bool)
    if len(b):
        sp = _SPACE[b]
        maybe = _MAYBE_SPACE_END[b]
        two = (b >= 0xC3) & (b < 0xE0)
        visible = ~sp
        visible[1:] &= ~maybe[1:] | two[:-1]
        visible[0] &= not maybe[0]
        begin[1:-1] = sp[1:] & visible[:-1]
        full = offsets[:-1][offsets[1:] > offsets[:-1]]
        begin[full] = True
    at = np.flatnonzero(begin[:-1])
    count = np.diff(np.searchsorted(at, offsets))
    return string_view(np.append(at, len(b)), b), count


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts: bytes, start and end of each word, words per text."""
    offsets, b = buffers(texts)
    if lower and len(b):
        b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    seen = np.zeros(len(b) + 2, bool)
    seen[1:-1] = ~_SPACE[b]
    cut = np.zeros(len(b) + 1, bool)
    cut[offsets] = True
    first = seen[1:] & (~seen[:-1] | cut)
    last = seen[:-1] & (~seen[1:] | cut)
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    return b, start, end, np.diff(np.searchsorted(start, offsets))


def word_column(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words as one binary column."""
    n = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=n[1:])
    at = np.repeat(start - n[:-1], end - start) + np.arange(n[-1])
    return string_view(n, b[at], pa.binary())


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column of ``counts`` values each."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), values)


def ragged(lens: np.ndarray, codes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` (run k has ``lens[k]`` values) that ``codes`` asks for, in order, and their lengths."""
    offs = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offs[1:])
    n = lens[codes]
    ends = np.cumsum(n)
    at = np.repeat(offs[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    return flat[at], n
