"""Pixels of PNG bytes that lie in a column (the image source reads files only)."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by colour type (grey, colour, palette, grey with alpha, colour with alpha).
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Modes of the image source by channels.
MODES = {1: 0, 3: 16, 4: 24}
IMAGE = "origin string, height int, width int, nChannels int, mode int, data binary"


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(data) or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(data[at + 4 : at + 8 + size]):
            raise ValueError("a chunk is cut or damaged")
        yield data[at + 4 : at + 8], body
        at += 12 + size


def _unfiltered(raw: bytes, height: int, width: int, n: int) -> np.ndarray:
    """Bytes of the pixels (height, width, n) from lines that each name the filter they went through."""
    lines = np.frombuffer(raw, np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height + 1, width, n), np.uint8)  # the line above the first is zero
    for y in range(height):
        kind, line, up = lines[y, 0], lines[y, 1:].reshape(width, n), out[y].astype(np.int64)
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            out[y + 1] = np.cumsum(line, axis=0, dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            out[y + 1] = line + out[y]
        elif kind in (3, 4):
            left = corner = np.zeros(n, np.int64)
            for x in range(width):
                if kind == 3:
                    near = (left + up[x]) // 2
                else:
                    a, b, c = abs(up[x] - corner), abs(left - corner), abs(left + up[x] - 2 * corner)
                    near = np.where((a <= b) & (a <= c), left, np.where(b <= c, up[x], corner))
                left, corner = (line[x] + near) & 255, up[x]
                out[y + 1, x] = left
        else:
            raise ValueError(f"no filter {kind}")
    return out[1:]


def pixels(data: bytes | None, most: int) -> np.ndarray | None:
    """(height, width, channels) of 8 bits, colours as blue, green, red and alpha; None where ``data`` is no whole PNG of 8 or 16 bits
    a sample, is interlaced or has more than ``most`` pixels."""
    if data is None or not bytes(data).startswith(SIGNATURE):
        return None
    try:
        head, palette, alpha, packed, ended = None, None, b"", [], False
        for name, body in _chunks(bytes(data)):
            if name == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif name == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif name == b"tRNS":
                alpha = body
            elif name == b"IDAT":
                packed.append(body)
            ended |= name == b"IEND"
        width, height, depth, colour, _, _, interlaced = head
        n = SAMPLES[colour]
        if not ended or interlaced or depth not in (8, 16) or not 0 < width * height <= most:
            return None
        size = height * (1 + width * n * depth // 8)
        raw = zlib.decompressobj().decompress(b"".join(packed), size)
        px = _unfiltered(raw, height, width, n * depth // 8)
    except (ValueError, TypeError, KeyError, struct.error, zlib.error):
        return None
    if depth == 16:
        px = px[..., ::2]
    if colour == 3:
        if palette is None or px.max() >= len(palette):
            return None
        clear = np.frombuffer(alpha.ljust(len(palette), b"\xff")[: len(palette)], np.uint8)
        px = np.concatenate([palette, clear[:, None]] if alpha else [palette], axis=1)[px[..., 0]]
    elif colour == 4:
        px = px[..., [0, 0, 0, 1]]
    return px if px.shape[2] == 1 else px[..., [2, 1, 0, 3][: px.shape[2]]]


def decoded(content: Column, origin: Column | None = None, most: int = 1 << 26) -> Column:
    """S3: a struct like the image source's from PNG bytes. What can't be decoded stays, with height, width, channels and
    mode of -1 and no data, as do NULL, empty and cut bytes and images of more than ``most`` pixels."""

    @F.pandas_udf(IMAGE)
    def of(data: pd.Series, name: pd.Series) -> pd.DataFrame:
        rows = []
        for d, o in zip(data, name, strict=True):
            px = pixels(d, most)
            rows.append((o, -1, -1, -1, -1, b"") if px is None else (o, *px.shape, MODES[px.shape[2]], px.tobytes()))
        return pd.DataFrame(rows, columns=["origin", "height", "width", "nChannels", "mode", "data"])

    return of(content, F.lit("") if origin is None else origin)


def packed(px: np.ndarray) -> bytes:
    """PNG bytes of 8-bit pixels (height, width, channels): grey, or blue, green and red."""
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    height, width, n = px.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), px[..., ::-1].reshape(height, -1)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if n == 3 else 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def encoded(height: Column, width: Column, channels: Column, data: Column) -> Column:
    """PNG bytes of 8-bit pixels: one channel is grey, three are blue, green and red. NULL where ``data`` is."""

    @F.pandas_udf("binary")
    def of(h: pd.Series, w: pd.Series, n: pd.Series, values: pd.Series) -> pd.Series:
        shaped = zip(h, w, n, values, strict=True)
        return pd.Series([None if d is None else packed(np.frombuffer(d, np.uint8).reshape(int(a), int(b), int(c))) for a, b, c, d in shaped], dtype=object)

    return of(height, width, channels, data)
