"""Binary forms of tiles: raster tiles (LZ4 block), float PNG and RGBA PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

from ..functions.dtypes import NUMPY, SENTINELS

#: Signature, version, type codes in order, and the code of the LZ4 block compression.
SIGNATURE, VERSION, LZ4 = 0x454C4954, 1, 0
TYPES = ("i8", "u8", "i16", "u16", "i32", "u32", "i64", "u64", "f32", "f64")
_HEAD = struct.Struct("<IHBBHHI")
_PNG = b"\x89PNG\r\n\x1a\n"


def with_sentinel(values: np.ndarray, dtype: str) -> np.ndarray:
    """Doubles with NaN for no data as the type, with its sentinel; what it cannot hold is no data too."""
    if dtype in ("f32", "f64"):
        return values.astype(NUMPY[dtype])
    lo, hi = (SENTINELS[dtype] + 1, -SENTINELS[dtype] - 1) if dtype[0] == "i" else (0, SENTINELS[dtype] - 1)
    cut = np.trunc(values)
    bad = ~np.isfinite(cut) | (cut < lo) | (cut > hi)
    out = np.where(bad, 0, cut).astype(NUMPY[dtype])
    out[bad] = SENTINELS[dtype]
    return out


def without_sentinel(values: np.ndarray, dtype: str) -> np.ndarray:
    out = values.astype(float)
    if dtype not in ("f32", "f64"):
        out[values == np.array(SENTINELS[dtype], values.dtype)] = np.nan
    return out


def encode_tile(values: np.ndarray, dtype: str = "f32") -> bytes:
    raw = with_sentinel(values, dtype).tobytes()
    body = pa.compress(raw, codec="lz4_raw", asbytes=True)
    h, w = values.shape
    return _HEAD.pack(SIGNATURE, VERSION, TYPES.index(dtype), LZ4, w, h, len(body)) + body


def decode_tile(data: bytes) -> tuple[np.ndarray, str]:
    """Values as doubles, NaN where there is no data, and the type."""
    if len(data) < _HEAD.size:
        raise ValueError("the tile is shorter than its header")
    signature, version, kind, compression, w, h, size = _HEAD.unpack_from(data)
    if signature != SIGNATURE or version != VERSION or compression != LZ4 or kind >= len(TYPES):
        raise ValueError("not a raster tile of a known version")
    if len(data) != _HEAD.size + size:
        raise ValueError("the tile has a wrong length")
    dtype = TYPES[kind]
    raw = pa.decompress(data[_HEAD.size :], decompressed_size=w * h * np.dtype(NUMPY[dtype]).itemsize, codec="lz4_raw", asbytes=True)
    return without_sentinel(np.frombuffer(raw, NUMPY[dtype]).reshape(h, w), dtype), dtype


def encode_png(rgba: np.ndarray) -> bytes:
    """(h, w, 4) bytes as an RGBA PNG."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w, _ = rgba.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgba.astype(np.uint8).reshape(h, -1)], axis=1)
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    if not data.startswith(_PNG):
        raise ValueError("not a PNG")
    at, body = len(_PNG), b""
    w = h = 0
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", part)
            if (depth, colour, interlace) != (8, 6, 0):
                raise ValueError("only RGBA8 without interlace is read")
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + 4 * w)
    out = np.zeros((h, 4 * w), np.int64)
    for r in range(h):
        kind, line = lines[r, 0], lines[r, 1:].astype(np.int64)
        above = out[r - 1] if r else np.zeros(4 * w, np.int64)
        if kind == 0:
            out[r] = line
        elif kind == 1:
            out[r] = line.reshape(-1, 4).cumsum(0).ravel() & 255
        elif kind == 2:
            out[r] = line + above & 255
        else:
            for k in range(4 * w):
                left, corner = (out[r, k - 4], above[k - 4]) if k >= 4 else (0, 0)
                if kind == 3:
                    guess = (left + above[k]) // 2
                else:
                    p = left + above[k] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above[k]), 1, above[k]), (abs(p - corner), 2, corner))[2]
                out[r, k] = line[k] + guess & 255
    return out.astype(np.uint8).reshape(h, w, 4)


def encode_float_png(values: np.ndarray) -> bytes:
    """The bytes of little-endian floats as RGBA; no data is opaque white."""
    raw = np.ascontiguousarray(values.astype("<f4")).view(np.uint8).reshape(*values.shape, 4).copy()
    raw[np.isnan(values)] = 255
    return encode_png(raw)


def decode_float_png(data: bytes) -> np.ndarray:
    raw = np.ascontiguousarray(decode_png(data))
    out = raw.view("<f4").reshape(raw.shape[:2]).astype(float)
    out[(raw == 255).all(axis=2)] = np.nan
    return out
