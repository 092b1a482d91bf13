"""Operator 6: media columns.

A payload becomes a 24-bit picture 64 pixels wide (192 bytes a row): Netpbm P6 or, chosen by the payload itself, BMP.
The encoded files are written as a binary column to the shared folder, read back, decoded to numpy arrays, area-resized
by integral images, and turned into NPY tiles and difference hashes, which are written to the shared folder too.

Cases: null text is empty and becomes one row of blanks; equal texts have equal values; repeated rows, null ids and extra
columns change nothing; a file of another size or format raises ValueError; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.llm.common import materialize, read_table
from secspark.llm.textbytes import column_bytes

ROW = 192
#: Rows of an Arrow batch that a task passes on at once, and bytes of media in it at most (one row at least).
BATCH, BATCH_BYTES = 1024, 8 << 20
TILE = 16


def padded(data: bytes) -> bytes:
    """``data`` with blanks up to a positive multiple of a row."""
    return data + b" " * (max(1, -(-len(data) // ROW)) * ROW - len(data))


def encode_ppm(a: np.ndarray) -> bytes:
    return b"P%d\n%d %d\n255\n" % (6 if a.ndim == 3 else 5, a.shape[1], a.shape[0]) + a.tobytes()


def encode_bmp(a: np.ndarray) -> bytes:
    """24 bits, bottom row first, rows padded to 4 bytes."""
    h, w, _ = a.shape
    pad = -3 * w % 4
    rows = np.zeros((h, 3 * w + pad), np.uint8)
    rows[:, : 3 * w] = a[::-1, :, ::-1].reshape(h, 3 * w)
    size = rows.size
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + size, 0, 0, 54, 40, w, h, 1, 24, 0, size, 2835, 2835, 0, 0) + rows.tobytes()


_PNM = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def decode(data: bytes) -> np.ndarray:
    """Netpbm P5 or P6 (8 bits) or an uncompressed 24-bit BMP as an array."""
    if data[:2] == b"BM":
        at, _, w, h = struct.unpack_from("<IIii", data, 10)
        if struct.unpack_from("<HHI", data, 26) != (1, 24, 0):
            raise ValueError("only uncompressed 24-bit BMP is read")
        stride = (3 * w + 3) // 4 * 4
        if len(data) < at + stride * abs(h):
            raise ValueError("BMP is cut off")
        rows = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)[:, : 3 * w].reshape(abs(h), w, 3)[:, :, ::-1]
        return rows[::-1] if h > 0 else rows
    m = _PNM.match(data)
    if not m or int(m[4]) != 255:
        raise ValueError("neither 8-bit Netpbm P5 or P6 nor BMP")
    w, h, c = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
    if len(data) - m.end() < w * h * c:
        raise ValueError("Netpbm is cut off")
    a = np.frombuffer(data, np.uint8, w * h * c, m.end())
    return a.reshape(h, w, 3) if c == 3 else a.reshape(h, w)


def _edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole part and fraction of the m + 1 edges of m equal cells over n pixels."""
    e = np.arange(m + 1) * (n / m)
    i = np.minimum(e.astype(np.int64), n - 1)
    return i, e - i


def area_resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean over each of h x w equal areas, by an integral image that is interpolated between pixels; float64. Only the
    integral's rows beside the areas' edges are made, so besides the picture it takes memory for h + 1 rows."""
    a = a if a.ndim == 3 else a[:, :, None]
    i, f = _edges(a.shape[0], h)
    rows, at = np.unique(i, return_inverse=True)
    above = np.add.reduceat(a, rows, axis=0, dtype=np.int64)
    above = np.concatenate((np.zeros((1, *a.shape[1:]), np.int64), np.cumsum(above[:-1], axis=0)))
    s = np.zeros((h + 1, a.shape[1] + 1, a.shape[2]))
    np.cumsum(above[at] + a[i] * f[:, None, None], axis=1, out=s[:, 1:])
    i, f = _edges(a.shape[1], w)
    s = s[:, i] + (s[:, i + 1] - s[:, i]) * f[None, :, None]
    d = s[1:, 1:] - s[:-1, 1:] - s[1:, :-1] + s[:-1, :-1]
    return d * (h * w / (a.shape[0] * a.shape[1]))


def difference_hash(a: np.ndarray) -> str:
    """64 bits: each of 8 x 8 areas of the grey picture against its right neighbour."""
    g = area_resize(a, 8, 9).mean(axis=2)
    return np.packbits((g[:, 1:] > g[:, :-1]).ravel()).tobytes().hex()


def npy_tile(a: np.ndarray, side: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(a, side, side)).clip(0, 255).astype(np.uint8))
    return out.getvalue()


def _encoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = column_bytes(b.column(1))
        i = 0
        while i < b.num_rows:
            j = min(b.num_rows, i + BATCH, max(i + 1, int(np.searchsorted(off, off[i] + BATCH_BYTES, "right")) - 1))
            media, n = [], []
            for x in range(i, j):
                raw = data[off[x] : off[x + 1]].tobytes()
                p = padded(raw)
                a = np.frombuffer(p, np.uint8).reshape(-1, ROW // 3, 3)
                media.append(encode_bmp(a) if zlib.crc32(p) & 1 else encode_ppm(a))
                n.append(len(raw))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
            i = j


def _decoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "dhash", "tile"]
    for b in batches:
        for i in range(0, b.num_rows, BATCH):
            part = b.slice(i, BATCH)
            cols: list[list] = [[] for _ in names[2:]]
            for m in part.column("media"):
                m = m.as_buffer().to_pybytes()
                a = decode(m)
                p = a.tobytes()
                for c, v in zip(cols, (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), difference_hash(a), npy_tile(a)), strict=True):
                    c.append(v)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table ``(doc_id, n_bytes, media)`` in the shared folder."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(src.mapInArrow(_encoder, "doc_id long, n_bytes long, media binary"), "media")


def read_media(media: DataFrame) -> DataFrame:
    """Decoded digests, difference hash and NPY tile of each stored picture."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decoder, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, tile binary")


def store_tiles(media: DataFrame) -> DataFrame:
    """``read_media`` as a table in the shared folder: the NPY files are its column ``tile``, beside the difference hashes."""
    return materialize(read_media(media), "tiles")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = store_tiles(store_media(read_table(spark, sf_dir, "documents")))
    feature = F.concat(F.lit("dhash="), F.col("dhash"), F.lit(";tile="), F.sha1("tile"))
    return back.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
