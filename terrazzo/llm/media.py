"""Media columns: Netpbm and BMP pictures as numpy arrays, NPY tiles and difference hashes.

``decode`` reads PBM, PGM and PPM (plain and raw, 8 and 16 bit) and uncompressed BMP of 1, 4,
8, 24 or 32 bits; ``shrink`` averages areas by an integral image, fractional borders
included; ``dhash`` compares neighbours of a 9 x 8 shrink.

Defined cases: null media give null outputs; bytes that are no such picture (empty ones too)
give null outputs and an ``error``; a text becomes a picture 64 samples wide, an empty or null
text one row of zeros; equal bytes give equal outputs.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import annotate, blobs

WIDTH = 64
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """Raw 8-bit PGM."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey or 24-bit colour BMP, rows bottom up and padded to four bytes."""
    height, width = samples.shape[:2]
    deep = samples.ndim == 3
    rows = samples[::-1, :, ::-1] if deep else samples[::-1]
    line = width * (3 if deep else 1)
    padded = np.zeros((height, -(-line // 4) * 4), np.uint8)
    padded[:, :line] = rows.reshape(height, line)
    palette = b"" if deep else np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).tobytes()
    at = 54 + len(palette)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24 if deep else 8, 0, padded.size, 2835, 2835, 0 if deep else 256, 0)
    return b"BM" + struct.pack("<IHHI", at + padded.size, 0, 0, at) + info + palette + padded.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = int(data[1:2]), 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    width, height, top = head[0], head[1], head[2] if len(head) > 2 else 1
    if width < 1 or height < 1 or not 0 < top < 65536:
        raise ValueError("bad Netpbm size")
    planes = 3 if kind in (3, 6) else 1
    n = width * height * planes
    if kind == 1:
        bits = re.sub(rb"#[^\n]*|[^01]", b"", data[at:])
        flat = 1 - (np.frombuffer(bits[:n], np.uint8) - 48)
    elif kind in (2, 3):
        flat = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n], dtype=np.int64)
    elif kind == 4:
        lines = np.frombuffer(data, np.uint8, -(-width // 8) * height, at + 1).reshape(height, -1)
        flat = 1 - np.unpackbits(lines, axis=1)[:, :width].ravel()
    else:
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    if flat.size != n:
        raise ValueError("Netpbm samples are missing")
    if top != 255:
        flat = np.rint(flat.astype(np.float64) * 255 / top)
    out = flat.astype(np.uint8)
    return out.reshape(height, width, 3) if planes == 3 else out.reshape(height, width)


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("broken BMP header")
    at, head = struct.unpack_from("<II", data, 10)
    width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    used = struct.unpack_from("<I", data, 46)[0]
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width < 1 or not height:
        raise ValueError("unsupported BMP")
    flip, height = height > 0, abs(height)
    line = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, line * height, at).reshape(height, line)
    if bits >= 24:
        out = rows[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1]
    else:
        index = rows if bits == 8 else np.unpackbits(rows, axis=1) if bits == 1 else np.stack([rows >> 4, rows & 15], 2).reshape(height, -1)
        palette = np.frombuffer(data, np.uint8, 4 * (used or 1 << bits), 14 + head).reshape(-1, 4)[:, 2::-1]
        out = palette[index[:, :width]]
        if (palette == palette[:, :1]).all():
            out = out[:, :, 0]
    return np.ascontiguousarray(out[::-1] if flip else out)


def decode(data: bytes) -> np.ndarray:
    """Samples, height x width or height x width x 3, scaled to 8 bits."""
    if re.match(rb"P[1-6]\s", data):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def _integrate(total: np.ndarray, n: int) -> np.ndarray:
    """Rows of a running sum at n + 1 even cuts, between two rows in proportion."""
    cuts = np.arange(n + 1) * ((len(total) - 1) / n)
    low = np.minimum(cuts.astype(np.int64), len(total) - 2)
    share = (cuts - low)[:, None]
    return total[low] * (1 - share) + total[low + 1] * share


def shrink(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each cell's area, from the integral image."""
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])
    cells = np.diff(np.diff(_integrate(_integrate(total, height).T, width).T, axis=0), axis=1)
    return cells * (height * width / (grey.shape[0] * grey.shape[1]))


def grey_of(samples: np.ndarray) -> np.ndarray:
    return samples if samples.ndim == 2 else samples @ np.array([0.299, 0.587, 0.114])


def dhash(grey: np.ndarray) -> int:
    """64 bits: is each cell of a 9 x 8 shrink darker than its right neighbour?"""
    cells = np.round(shrink(grey, 8, 9), 6)
    return int.from_bytes(np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes(), "big")


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def features(picture: np.ndarray, side: int) -> tuple[str, bytes]:
    """The difference hash and the NPY tile."""
    grey = grey_of(picture)
    return f"{dhash(grey):016x}", npy(np.rint(shrink(grey, side, side)).astype(np.uint8))


def stored_text(data: bytes, encode) -> bytes:
    """A picture of the bytes, zero-padded to full rows."""
    rows = max(1, -(-len(data) // WIDTH))
    return encode(np.frombuffer(data.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH))


def text_media(df: DataFrame, text: str = "text", form: str = "pgm", keep: list[str] | None = None) -> DataFrame:
    """Append ``media``: the text's bytes, zero-padded to rows of 64 samples, as a picture."""
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[form]

    def run(texts: pa.Array) -> list:
        rows = blobs(texts)
        return [[len(x) for x in rows], [stored_text(x, encode) for x in rows]]

    return annotate(df, run, [text], T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]), keep)


def media_features(df: DataFrame, media: str = "media", side: int = 16, keep: list[str] | None = None, samples: bool = False) -> DataFrame:
    """Append height, width, dhash, an NPY ``tile`` of side x side, and the decoded samples if asked."""

    def run(column: pa.Array) -> list:
        out: list[tuple] = []
        for data in column.to_pylist():
            if data is None:
                out.append((None,) * 6)
                continue
            try:
                picture = decode(data)
            except (ValueError, IndexError, struct.error) as broken:
                out.append((None, None, None, None, None, str(broken)))
                continue
            out.append((*picture.shape[:2], *features(picture, side), picture.tobytes() if samples else None, None))
        return [list(x) for x in zip(*out, strict=True)] if out else [[]] * 6

    fields = T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("dhash", T.StringType()), T.StructField("tile", T.BinaryType()), T.StructField("samples", T.BinaryType()), T.StructField("error", T.StringType())])
    return annotate(df, run, [media], fields, keep)


def media_digest(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The digest columns of a text's picture, all taken from its stored bytes.

    Pictures are stored, read back and dropped text by text, so no column of pictures is held.
    """

    def run(texts: pa.Array) -> list:
        out: list[tuple] = []
        for scalar in texts:
            data = (scalar.as_py() or "").encode()
            stored = stored_text(data, encode_pgm)
            picture = decode(stored)
            read = picture.tobytes()
            grey, tile = features(picture, 16)
            out.append((len(data), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{grey}-{hashlib.sha256(tile).hexdigest()[:16]}"))
        return [list(x) for x in zip(*out, strict=True)] if out else [[]] * 7

    fields = T.StructType([T.StructField(n, T.StringType() if n in ("payload_sha256", "media_sha256", "feature") else T.LongType()) for n in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")])
    return annotate(df, run, [text], fields, keep)
