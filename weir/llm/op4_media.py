"""Media columns: bytes kept as images, decoded to arrays, resized by integral images, tiled and hashed.

Binary PGM, PPM and BMP are read (8 bits a sample), PGM and BMP are written. Rows are independent: no shuffle,
memory for one image at a time.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.session import bound_batches, table

#: Samples of a row, which padding completes; side of a tile; rows of an image that are summed at once.
WIDTH, TILE, BAND = 64, 32, 4096
_PNM = re.compile(rb"P([56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s")


def encode_pgm(a: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.astype(np.uint8).tobytes()


def encode_bmp(a: np.ndarray) -> bytes:
    """A grey image as BMP with 8 bits a pixel, rows from the bottom up and padded to 4 bytes."""
    h, w = a.shape
    rows = np.zeros((h, (w + 3) // 4 * 4), np.uint8)
    rows[:, :w] = a[::-1]
    grey = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    grey[:, 3] = 0
    start = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + grey.tobytes() + rows.tobytes()


def decode(b: bytes) -> np.ndarray:
    """An array of height by width, by 3 for colour; ValueError for anything else than these formats."""
    if m := _PNM.match(b):
        w, h, most = (int(x) for x in m.groups()[1:])
        depth = 3 if m[1] == b"6" else 1
        if most > 255 or len(b) - m.end() < w * h * depth:
            raise ValueError("truncated or deep image")
        a = np.frombuffer(b, np.uint8, w * h * depth, m.end())
        return a.reshape(h, w, 3) if depth == 3 else a.reshape(h, w)
    if b[:2] == b"BM" and len(b) >= 54:
        start = struct.unpack_from("<I", b, 10)[0]
        size, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", b, 14)
        used = struct.unpack_from("<I", b, 46)[0]
        if packed or bits not in (8, 24):
            raise ValueError("compressed or odd image")
        line = (w * bits // 8 + 3) // 4 * 4
        a = np.frombuffer(b, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : w * bits // 8]
        a = a[::-1] if h > 0 else a
        if bits == 24:
            return a.reshape(abs(h), w, 3)[:, :, ::-1]
        palette = np.frombuffer(b, np.uint8, 4 * (used or 256), 14 + size).reshape(-1, 4)[:, 2::-1]
        colour = palette[a]
        return colour[:, :, 0] if (palette == palette[:, :1]).all() else colour
    raise ValueError("unknown image")


def _between(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The borders of n samples cut into equal parts: the sample that each lies in, and how far."""
    at = np.linspace(0, n, parts + 1)
    low = np.minimum(at.astype(int), n - 1)
    return low, (at - low).reshape(-1, 1)


def _integral_rows(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """These rows of the integral image (rows ascend), summed in bands: no more than BAND rows are held as numbers at once."""
    out = np.zeros((len(rows), a.shape[1] + 1))
    above = np.zeros(a.shape[1])
    for lo in range(0, a.shape[0], BAND):
        band = np.cumsum(a[lo : lo + BAND], axis=0, dtype=np.float64) + above
        here = np.flatnonzero((rows > lo) & (rows <= lo + len(band)))
        out[here, 1:] = band[rows[here] - lo - 1]
        above = band[-1]
    return np.cumsum(out, axis=1)


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each target cell covers, from the integral image, parts of samples included."""
    low, part = _between(a.shape[0], height)
    total = _integral_rows(a, low) * (1 - part) + _integral_rows(a, low + 1) * part
    low, part = _between(a.shape[1], width)
    edge = (total.T[low] * (1 - part) + total.T[low + 1] * part).T
    return np.diff(np.diff(edge, axis=0), axis=1) * (height * width / (a.shape[0] * a.shape[1]))


def difference_hash(a: np.ndarray) -> str:
    small = np.round(area_resize(a, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def tile(a: np.ndarray, side: int = TILE) -> bytes:
    """A side by side NPY file of bytes."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(a, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def pad(b: bytes, unit: int = WIDTH) -> bytes:
    return b + bytes(max(unit, -(-len(b) // unit) * unit) - len(b))


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, tile binary"


def _store(batches: Iterator[pa.RecordBatch], form: str) -> Iterator[pa.RecordBatch]:
    write = {"pgm": encode_pgm, "bmp": encode_bmp}[form]
    names = [x.split()[0] for x in _OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            rows = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                raw = (text.as_py() or "").encode()
                media = write(np.frombuffer(pad(raw), np.uint8).reshape(-1, WIDTH))
                image = decode(media)
                back = image.tobytes()
                rows.append((doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), media, tile(image)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def media_columns(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """doc_id, sizes and digests, feature (difference hash), media (the stored image) and tile (NPY) of each row of docs (doc_id, text).

    The payload is the text's UTF-8 bytes and as many zero bytes as complete a row of WIDTH samples (one row at
    least), so a null or empty text is a row of zeros. Repeated rows give equal rows, a null doc_id is kept;
    other columns are ignored; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_store, form=form), _OUT)


def op4_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents")).drop("media", "tile")
