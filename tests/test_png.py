"""Decoding of PNG columns: every filter and kind of pixel, and what can't be decoded."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from modsieve.functions import png
from modsieve.operators import frames as FR
from modsieve.sources import readers

GREY, RGB, PALETTE, GREY_ALPHA, RGBA = 0, 2, 3, 4, 6


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def predicted(kind, a, b, c):
    nearest = min((abs(a + b - c - v), k) for k, v in enumerate((a, b, c)))[1]
    return (0, a, b, (a + b) // 2, (a, b, c)[nearest])[kind]


def write(px, colour, depth=8, kinds=(0, 1, 2, 3, 4), extra=b"", interlaced=0):
    """A PNG of samples (height, width, n), each line filtered in the next of ``kinds``, byte by byte."""
    h, w, n = px.shape
    lines = px.astype(">u2" if depth == 16 else np.uint8).tobytes()
    size, step, raw = w * n * depth // 8, n * depth // 8, b""
    for y in range(h):
        kind, line, above = kinds[y % len(kinds)], lines[y * size : (y + 1) * size], lines[(y - 1) * size : y * size] if y else bytes(size)
        at = lambda row, i: row[i] if i >= 0 else 0
        raw += bytes([kind]) + bytes((line[i] - predicted(kind, at(line, i - step), above[i], at(above, i - step))) & 255 for i in range(size))
    head = struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced)
    packed = zlib.compress(raw)
    return png.SIGNATURE + chunk(b"IHDR", head) + extra + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour, n, depth", [(GREY, 1, 8), (RGB, 3, 8), (GREY_ALPHA, 2, 8), (RGBA, 4, 8), (GREY, 1, 16), (RGB, 3, 16), (RGBA, 4, 16)])
def test_every_filter(colour, n, depth):
    g = np.random.default_rng(colour * 100 + depth)
    for h, w in ((11, 7), (1, 1), (6, 40)):
        px = g.integers(0, 1 << depth, (h, w, n))
        px[h // 2 :] //= 3  # near values, for the predictors
        high = px >> (depth - 8)
        places = {GREY: [0], RGB: [2, 1, 0], GREY_ALPHA: [0, 0, 0, 1], RGBA: [2, 1, 0, 3]}[colour]
        assert np.array_equal(png.pixels(write(px, colour, depth), 10**6), high[..., places])


def test_palettes():
    px = np.array([[[0], [2]], [[1], [0]]])
    colours = chunk(b"PLTE", bytes([10, 20, 30, 40, 50, 60, 70, 80, 90]))
    got = png.pixels(write(px, PALETTE, extra=colours), 100)
    assert got.tolist() == [[[30, 20, 10], [90, 80, 70]], [[60, 50, 40], [30, 20, 10]]]
    clear = png.pixels(write(px, PALETTE, extra=colours + chunk(b"tRNS", bytes([5]))), 100)
    assert clear[0].tolist() == [[30, 20, 10, 5], [90, 80, 70, 255]]
    assert png.pixels(write(px, PALETTE), 100) is None and png.pixels(write(px + 2, PALETTE, extra=colours), 100) is None


def test_what_cannot_be_decoded_stays(spark):
    whole = write(np.full((4, 5, 1), 7), GREY)
    g, damaged = random.Random(1), []
    for _ in range(60):
        i = g.randrange(8, len(whole))
        damaged.append(whole[:i] + bytes([whole[i] ^ (1 << g.randrange(8))]) + whole[i + 1 :])
    cut = [whole[:i] for i in range(len(whole))]
    odd = [None, b"", b"GIF89a", whole[:8], write(np.full((4, 5, 1), 7), GREY, interlaced=1), b"\x89PNG"]
    rows = [("whole", whole)] + [("bad", d) for d in damaged + cut + odd]
    got = spark.createDataFrame(rows, "name string, content binary").withColumn("image", png.decoded(F.col("content"), F.col("name")))
    told = FR.hashed(got).select("name", "image.origin", "image.height", "image.width", "image.nChannels", "image.mode", "image.data", "hash").collect()
    assert len(told) == len(rows)
    assert [tuple(r)[1:7] for r in told if r.name == "whole"] == [("whole", 4, 5, 1, 0, bytearray([7] * 20))]
    assert {(r.height, r.width, r.nChannels, r.mode, bytes(r.data), r.hash) for r in told if r.name == "bad"} == {(-1, -1, -1, -1, b"", None)}
    assert png.pixels(whole, 19) is None and png.pixels(whole, 20) is not None


def test_equal_to_the_image_source_and_a_round_trip(spark, tmp_path):
    g = np.random.default_rng(5)
    for name, colour, n in (("grey", GREY, 1), ("rgb", RGB, 3), ("rgba", RGBA, 4)):
        (tmp_path / f"{name}.png").write_bytes(write(g.integers(0, 256, (20, 13, n)), colour))
    own = readers.media_files(spark, str(tmp_path)).select("path", png.decoded(F.col("content")).alias("i")).select("path", "i.height", "i.width", "i.nChannels", "i.mode", "i.data")
    theirs = readers.images(spark, str(tmp_path)).select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.mode", "image.data")
    name = lambda r: r.path.rsplit("/", 1)[-1]
    assert {name(r): tuple(r)[1:] for r in own.collect()} == {name(r): tuple(r)[1:] for r in theirs.collect()}
    back = own.filter("nChannels < 4").select("data", png.decoded(png.encoded(F.col("height"), F.col("width"), F.col("nChannels"), F.col("data"))).getField("data").alias("again"))
    assert back.filter("data = again").count() == 2
