"""Media columns: baseline JPEG files in a binary column, their dimensions and thumbnail hashes.

Reading parses the markers, Huffman-decodes the scan of every image and keeps
the quantised coefficients; the DC coefficients of the luminance blocks are the
thumbnail. Restart intervals are decoded side by side in numpy, those of many
images at a time.

Writing stores bytes as the format's own units, quantised coefficients, without
loss: a byte is a coefficient of magnitude category 8 (its value bits are the
byte itself), 64 bytes are a block in zig-zag order, and every block is a
restart interval. A comment segment holds the number of bytes and of padded bytes.

Defined results: a null text is an empty one and is padded to 64 zero bytes;
equal texts give equal files; a null, truncated or unsupported image gives null
dimensions and a null thumbnail; repeated rows give a row each; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oppflow.llm.arrowtext import buffers, pieces, release

#: Bytes of text encoded, or of images decoded, at a time.
PIECE_BYTES = 1 << 20
_MOST_BLOCKS_WIDE = 8191  # 65535 samples


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: One Huffman code, "0", for category 8 after no zeros; DC and AC alike.
_ONE_CODE = bytes([1] + [0] * 15 + [8])
_TABLES = _segment(0xDB, bytes([0] + [1] * 64)), _segment(0xC4, b"\x00" + _ONE_CODE) + _segment(0xC4, b"\x10" + _ONE_CODE) + _segment(0xDD, b"\x00\x01") + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def _grid(blocks: int) -> tuple[int, int]:
    """Blocks across and down for at least so many blocks."""
    wide = min(int(np.ceil(np.sqrt(blocks))), _MOST_BLOCKS_WIDE)
    return wide, -(-blocks // wide)


def encode_bytes(body: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """One JPEG for each run of ``sizes`` bytes of ``body``."""
    padded = np.maximum(-(-sizes // 64) * 64, 64)
    grids = [_grid(int(p) // 64) for p in padded]
    blocks = np.array([w * h for w, h in grids], np.int64)
    ends = np.cumsum(blocks)
    flat = np.zeros(int(ends[-1]) * 64, np.uint8)
    at = np.repeat((ends - blocks) * 64 - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(body))
    flat[at] = body
    bits = np.zeros((len(flat), 9), np.uint8)
    bits[:, 1:] = np.unpackbits(flat[:, None], axis=1)
    scan = np.empty((int(ends[-1]), 74), np.uint8)
    scan[:, :72] = np.packbits(bits.reshape(-1, 576), axis=1)
    number = np.arange(len(scan)) - np.repeat(ends - blocks, blocks)
    scan[:, 72], scan[:, 73] = 0xFF, 0xD0 + number % 8
    stuff = scan == 0xFF
    stuff[:, 72:] = False
    before = np.concatenate([[0], np.cumsum(stuff.sum(axis=1))])
    stream = np.insert(scan.ravel(), np.flatnonzero(stuff.ravel()) + 1, 0).tobytes()
    out = []
    for (wide, high), n, p, e, count in zip(grids, sizes.tolist(), padded.tolist(), ends.tolist(), blocks.tolist(), strict=True):
        s = e - count
        head = b"\xff\xd8" + _segment(0xFE, struct.pack(">QQ", n, p)) + _TABLES[0] + _segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + b"\x01\x11\x00") + _TABLES[1]
        out.append(head + stream[s * 74 + int(before[s]) : e * 74 + int(before[e]) - 2] + b"\xff\xd9")
    return out


def parse(data: bytes) -> dict:
    """Markers of a baseline JPEG with one scan; ``ValueError`` for anything else."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no image")
    out: dict = {"tables": {}, "restart": 0, "comment": b""}
    at = 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("truncated")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        (n,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xC4:
            while body:
                counts = list(body[1:17])
                out["tables"][body[0]] = (bytes(counts), body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            (out["restart"],) = struct.unpack(">H", body)
        elif marker == 0xFE:
            out["comment"] = body
        elif marker == 0xC0:
            depth, out["height"], out["width"], n_parts = struct.unpack_from(">BHHB", body)
            if depth != 8 or not out["height"] or not out["width"]:
                raise ValueError("unsupported samples")
            out["parts"] = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15) for k in range(n_parts)]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not baseline")
        elif marker == 0xDA:
            if "parts" not in out or body[0] != len(out["parts"]):
                raise ValueError("several scans")
            chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            break
    parts = out["parts"] if len(out["parts"]) > 1 else [(out["parts"][0][0], 1, 1)]
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    out["mcus"] = -(-out["width"] // (8 * wide)), -(-out["height"] // (8 * high))
    layout = tuple((k, chosen[p[0]] >> 4, 16 + (chosen[p[0]] & 15)) for k, p in enumerate(parts) for _ in range(p[1] * p[2]))
    if any(t not in out["tables"] for _, dc, ac in layout for t in (dc, ac)):
        raise ValueError("a table is missing")
    out["luma"] = parts[0][1:]
    out["scan"] = at
    out["group"] = (layout, tuple((t, out["tables"][t]) for t in sorted({t for _, dc, ac in layout for t in (dc, ac)})))
    return out


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """Code length (high byte) and symbol for each 16 bits that a code may begin; 0 for no code."""
    table, code, k = np.zeros(1 << 16, np.uint16), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _split(data: bytes, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The scan without stuffing and markers, and where each restart interval begins and the last ends."""
    s = np.frombuffer(data, np.uint8, len(data) - start, start)
    ff = np.flatnonzero(s[:-1] == 0xFF)
    nxt = s[ff + 1]
    end = ff[(nxt != 0) & (nxt != 0xFF) & ((nxt < 0xD0) | (nxt > 0xD7))]
    stop = int(end[0]) if len(end) else len(s)
    restart = ff[(nxt >= 0xD0) & (nxt <= 0xD7) & (ff < stop)]
    keep = np.ones(stop, bool)
    keep[ff[(nxt == 0) & (ff + 1 < stop)] + 1] = False
    keep[restart] = False
    keep[restart + 1] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    return s[:stop][keep], np.concatenate([[0], kept[restart], kept[-1:]])


def _decode_group(images: list[tuple[dict, bytes]]) -> list[np.ndarray | None]:
    """Coefficients (blocks in scan order, 64 in zig-zag order) of images with the same tables and layout."""
    layout, tables = images[0][0]["group"]
    table = {t: _lookup(*x) for t, x in tables}
    bodies, starts, mcus, owner, base = [], [], [], [], 0
    for k, (info, data) in enumerate(images):
        body, cuts = _split(data, info["scan"])
        total = info["mcus"][0] * info["mcus"][1]
        each = info["restart"] or total
        n = -(-total // each)
        starts.append(cuts[:-1][:n] + base)
        got = len(starts[-1])
        mcus.append(np.minimum(each, total - each * np.arange(got)) if got == n else np.zeros(got, np.int64))
        owner.append(np.full(got, k))
        bodies.append(body)
        base += len(body)
    buf = np.concatenate([*bodies, np.zeros(16, np.uint8)])
    window = np.zeros(len(buf) - 8, np.uint64)
    for k in range(8):
        window |= buf[k : len(buf) - 8 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    begin, n_mcus, of = np.concatenate(starts), np.concatenate(mcus), np.concatenate(owner)
    limit = (len(window) - 1) * 8
    per_mcu = len(layout)
    first = (np.cumsum(n_mcus) - n_mcus) * per_mcu
    coef = np.zeros((int(n_mcus.sum()) * per_mcu, 64), np.int16)
    order = np.argsort(-n_mcus, kind="stable")
    pos, first, n_left = begin[order].astype(np.int64) * 8, first[order], n_mcus[order]
    bad = np.zeros(len(order), bool)
    pred = np.zeros((len(order), 1 + max(p for p, _, _ in layout)), np.int64)

    def read(lut: np.ndarray, p: np.ndarray):
        w = window[np.minimum(p, limit) >> 3] << (p & 7).astype(np.uint64)
        entry = lut[(w >> np.uint64(48)).astype(np.int64)]
        n, sym = (entry >> 8).astype(np.int64), (entry & 255).astype(np.int64)
        size = sym & 15
        v = ((w << n.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        v = np.where(v < (1 << size) >> 1, v - (1 << size) + 1, v)
        return n, sym, size, v

    for m in range(int(n_left[0]) if len(n_left) else 0):
        live = int(np.searchsorted(-n_left, -m, "left"))
        for j, (part, dc, ac) in enumerate(layout):
            block = first[:live] + m * per_mcu + j
            n, _, size, v = read(table[dc], pos[:live])
            bad[:live] |= n == 0
            pred[:live, part] += np.where(size > 0, v, 0)
            coef[block, 0] = pred[:live, part]
            pos[:live] += n + size
            who, k = np.arange(live), np.ones(live, np.int64)
            while len(who):
                n, sym, size, v = read(table[ac], pos[who])
                pos[who] += n + size
                bad[who] |= n == 0
                k += np.where((size == 0) & (sym != 0xF0), 64, sym >> 4)
                put = (size > 0) & (k < 64)
                if put.all():
                    coef[block[who], k] = v
                else:
                    coef[block[who[put]], k[put]] = v[put]
                k += 1
                more = k < 64
                if not more.all():
                    who, k = who[more], k[more]
    broken = set(of[order[bad]].tolist())
    cut = np.concatenate([[0], np.cumsum(np.bincount(of, weights=n_mcus, minlength=len(images)))]).astype(np.int64) * per_mcu
    return [None if k in broken or cut[k + 1] == cut[k] else coef[cut[k] : cut[k + 1]] for k in range(len(images))]


def decode_images(datas: list[bytes | None]) -> list[tuple[dict, np.ndarray] | None]:
    """Header and coefficients of every image; None where it can't be read."""
    groups: dict = {}
    for k, data in enumerate(datas):
        try:
            info = parse(data or b"")
        except (ValueError, IndexError, KeyError, struct.error):
            continue
        groups.setdefault(info["group"], []).append((k, info))
    out: list = [None] * len(datas)
    for members in groups.values():
        for (k, info), c in zip(members, _decode_group([(i, datas[j]) for j, i in members]), strict=True):
            out[k] = (info, c) if c is not None else None
    return out


def thumbnail(info: dict, coef: np.ndarray) -> np.ndarray:
    """DC coefficients of the luminance blocks, as they stand in the picture."""
    wide, high = info["mcus"]
    h, v = info["luma"]
    per = len(info["group"][0])
    dc = coef[:, 0].reshape(high, wide, per)[:, :, : h * v].reshape(high, wide, v, h)
    return dc.transpose(0, 2, 1, 3).reshape(high * v, wide * h)


def thumbnail_hash(dc: np.ndarray) -> str:
    """16 hex digits: which of 8 x 8 areas of the thumbnail are on average above the mean of the areas."""
    edges = [np.arange(9) * n // 8 for n in dc.shape]
    sums = np.add.reduceat(np.add.reduceat(dc.astype(np.int64), edges[0][:8], axis=0), edges[1][:8], axis=1)  # an empty area is the point at its edge
    sizes = [np.maximum(np.diff(e), 1) for e in edges]
    # averages over a common denominator, in whole numbers of any size
    high, wide = ([math.lcm(*n.tolist()) // x for x in n.tolist()] for n in sizes)
    areas = sums.astype(object) * np.outer(np.array(high, object), np.array(wide, object))
    return np.packbits((areas * 64 > areas.sum()).astype(bool)).tobytes().hex()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, media binary``: the text's bytes, zero-padded, as a JPEG."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in pieces(batches, PIECE_BYTES):
            offsets, body = buffers(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encode_bytes(body, np.diff(offsets)), pa.binary())], ["id", "media"])

    return src.mapInArrow(run, T.StructType([src.schema["id"], T.StructField("media", T.BinaryType())]))


def describe(media: DataFrame, payload: bool = True) -> DataFrame:
    """``id, width, height, thumbnail`` of column ``media``, and with ``payload`` what :func:`store` put there.

    ``payload`` columns: ``n_bytes, payload_bytes, payload_sha256, tail_crc32``.
    """
    src = media.select("id", "media")
    fields = [src.schema["id"], T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("thumbnail", T.StringType())]
    if payload:
        fields += [T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType())]
    fields += [T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType())]
    names = [f.name for f in fields]
    types = [pa.int32(), pa.int32(), pa.string(), *([pa.int64(), pa.int64(), pa.string(), pa.int64()] * payload), pa.int64(), pa.string()]

    def row(data, got):
        own = (len(data), hashlib.sha256(data).hexdigest()) if data is not None else (None, None)
        if got is None:
            return (None,) * (7 if payload else 3) + own
        info, coef = got
        out = (info["width"], info["height"], thumbnail_hash(thumbnail(info, coef)))
        if payload:
            n, padded = struct.unpack(">QQ", info["comment"]) if len(info["comment"]) == 16 else (None, None)
            if n is None:
                return (*out, None, None, None, None, *own)
            flat = coef.ravel()[:padded]
            raw = np.where(flat < 0, flat + 255, flat).astype(np.uint8).tobytes()
            out += (n, padded, hashlib.sha256(raw).hexdigest(), crc32(raw[-64:]))
        return out + own

    def run(batches):
        for b in pieces(batches, PIECE_BYTES, "media"):
            datas = b.column(1).to_pylist()
            rows = [row(d, g) for d, g in zip(datas, decode_images(datas), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names)
            release()

    return src.mapInArrow(run, T.StructType(fields))


def digest(docs: DataFrame) -> DataFrame:
    """Rows of the query, from the stored files."""
    got = describe(store(docs))
    feature = F.format_string("%dx%d:%s", "width", "height", "thumbnail")
    return got.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
