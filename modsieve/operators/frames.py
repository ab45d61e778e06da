"""Frames: listing, sampling, budgets, perceptual hashes and de-duplication."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def paired(listing: DataFrame, logs: DataFrame) -> DataFrame:
    """Files (asset_id, path) paired by position with timestamps (asset_id, ts array<double>);
    the ordinal stands in where there are fewer timestamps."""
    order = Window.partitionBy("asset_id").orderBy("path")
    placed = listing.withColumn("frame_idx", (F.row_number().over(order) - 1).cast("long"))
    times = logs.select("asset_id", F.posexplode("ts").alias("_pos", "_ts"))
    return placed.join(times, (placed["asset_id"] == times["asset_id"]) & (F.col("frame_idx") == F.col("_pos")), "left").select(placed["asset_id"], "path", "frame_idx", F.coalesce("_ts", F.col("frame_idx").cast("double")).alias("timestamp_sec"))


def log_times(logs: DataFrame) -> DataFrame:
    """(asset_id, frame_idx, timestamp_sec) from extraction logs (asset_id, value), whole files."""
    found = F.regexp_extract_all("value", F.lit(r"pts_time:\s*([0-9]+(?:\.[0-9]+)?)"), 1)
    return logs.select("asset_id", F.posexplode(found).alias("frame_idx", "_t")).select("asset_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("_t").cast("double").alias("timestamp_sec"))


def budget(frames: DataFrame, limit: int) -> DataFrame:
    """The bag union of workflows' frames in selection order, cut at the extraction
    budget and numbered anew."""
    order = Window.partitionBy("asset_id").orderBy("wf_pos", "wf_idx")
    return frames.withColumn("new_idx", (F.row_number().over(order) - 1).cast("long")).filter(F.col("new_idx") < limit)


def capped(frames: DataFrame, most: int) -> DataFrame:
    """The first ``most`` kept frames in workflow order (0: all), and how many were cut."""
    order = Window.partitionBy("asset_id").orderBy("wf_pos", "wf_idx")
    placed = frames.withColumn("_n", F.row_number().over(order)).withColumn("frames_cut", F.greatest(F.lit(0), F.count("*").over(Window.partitionBy("asset_id")) - (most or (1 << 62))).cast("long"))
    return (placed.filter(F.col("_n") <= most) if most else placed).drop("_n")


def ordered(frames: DataFrame) -> DataFrame:
    """Final place by time, frames without one last, stable on the index."""
    order = Window.partitionBy("asset_id").orderBy(F.asc_nulls_last("timestamp_sec"), "frame_idx")
    return frames.withColumn("frame_ord", (F.row_number().over(order) - 1).cast("long"))


def interval(frames: DataFrame, seconds: float, head: float | None = None) -> DataFrame:
    """The first frame of every ``seconds``, within the first ``head`` seconds if given."""
    rows = frames.filter(F.col("timestamp_sec") < head) if head is not None else frames
    order = Window.partitionBy("asset_id", F.floor(F.col("timestamp_sec") / seconds)).orderBy("timestamp_sec", "frame_idx")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def scenes(frames: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Frames whose scene score is above ``threshold``; no score, no selection."""
    return frames.filter(F.col("scene") > threshold)


def keyframes(frames: DataFrame) -> DataFrame:
    return frames.filter("is_keyframe")


def min_gap(frames: DataFrame, threshold: float = 0.4, gap: float = 5.0) -> DataFrame:
    """Scene frames at least ``gap`` seconds after the one selected before. Candidates of an
    asset are bounded by the extraction budget."""
    one = F.struct("timestamp_sec", "frame_idx")
    listed = scenes(frames, threshold).groupBy("asset_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    kind = "array<struct<timestamp_sec:double,frame_idx:bigint>>"
    take = lambda acc, x: F.when((F.size(acc) == 0) | (x["timestamp_sec"] - F.element_at(acc, -1)["timestamp_sec"] >= gap), F.concat(acc, F.array(x)).cast(kind)).otherwise(acc)
    return listed.select("asset_id", F.inline(F.aggregate(F.col("c").cast(kind), F.array().cast(kind), take)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(frames: DataFrame, threshold: int) -> DataFrame:
    """Pairs of an asset's frames (asset_id, frame_idx, hash) within ``threshold`` bits.
    An equi-join on the asset; frames of an asset are bounded by the extraction budget."""
    a = frames.filter("hash is not null").select("asset_id", F.col("frame_idx").alias("a_idx"), F.col("hash").alias("_a"))
    b = frames.filter("hash is not null").select("asset_id", F.col("frame_idx").alias("b_idx"), F.col("hash").alias("_b"))
    return a.join(b, "asset_id").filter("a_idx < b_idx").withColumn("distance", hamming(F.col("_a"), F.col("_b")).cast("int")).filter(F.col("distance") <= threshold).select("asset_id", "a_idx", "b_idx", "distance")


def dedup(frames: DataFrame, threshold: int) -> DataFrame:
    """Frames kept by the greedy rule, in index order: one goes if it is within ``threshold``
    bits of a frame already kept. Frames without a hash stay and are not compared with; a negative
    threshold keeps all. JVM-side: a fold over the asset's frames, bounded by the budget."""
    kind = "array<struct<frame_idx:bigint,hash:bigint>>"
    if threshold < 0:
        return frames.select("asset_id", F.col("frame_idx").cast("long").alias("frame_idx"), "hash", F.col("frame_idx").cast("long").alias("new_idx"))
    listed = frames.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct(F.col("frame_idx").cast("long").alias("frame_idx"), "hash"))).cast(kind).alias("f"))
    near = lambda acc, x: F.exists(acc, lambda k: F.coalesce(hamming(k["hash"], x["hash"]) <= threshold, F.lit(False)))
    kept = F.aggregate("f", F.array().cast(kind), lambda acc, x: F.when(near(acc, x), acc).otherwise(F.concat(acc, F.array(x)).cast(kind)))
    return listed.select("asset_id", F.posexplode(kept).alias("new_idx", "k")).select("asset_id", "k.frame_idx", "k.hash", F.col("new_idx").cast("long").alias("new_idx"))


GRID_W, GRID_H, MOST = 9, 8, 8


def _cells(n: int, parts: int) -> list[np.ndarray]:
    """At most ``MOST`` evenly spaced places in each of ``parts`` spans of 0..n-1."""
    out = []
    for k in range(parts):
        lo, hi = k * n // parts, max((k + 1) * n // parts, k * n // parts + 1)
        out.append(np.arange(lo, hi, max(1, -(-(hi - lo) // MOST))))
    return out


def dhash(width: int, height: int, channels: int, data: bytes) -> int | None:
    """The signed 64-bit difference hash of decoded pixels (BGR order), or None."""
    if width <= 0 or height <= 0 or not data:
        return None
    rows, cols = _cells(height, GRID_H), _cells(width, GRID_W)
    # only the pixels that some cell samples, whatever the image's size
    sampled = np.frombuffer(data, np.uint8).reshape(height, width, channels)[np.concatenate(rows)][:, np.concatenate(cols)]
    px = sampled.astype(np.float64) * 257
    if channels == 1:
        luma = 0.299 * px[..., 0] + 0.587 * px[..., 0] + 0.114 * px[..., 0]
    else:
        b, g, r = (np.floor(px[..., i] * px[..., 3] / 257 / 255) if channels == 4 else px[..., i] for i in range(3))
        luma = 0.299 * r + 0.587 * g + 0.114 * b
    tall, wide = [len(y) for y in rows], [len(x) for x in cols]
    if len(set(tall)) == len(set(wide)) == 1:
        grid = luma.reshape(GRID_H, tall[0], GRID_W, wide[0]).transpose(0, 2, 1, 3).reshape(GRID_H, GRID_W, -1).mean(axis=2)
    else:
        y0, x0 = np.cumsum([0, *tall]), np.cumsum([0, *wide])
        grid = np.array([[luma[y0[i] : y0[i + 1], x0[j] : x0[j + 1]].ravel().mean() for j in range(GRID_W)] for i in range(GRID_H)])
    bits = (grid[:, :-1] < grid[:, 1:]).ravel()
    value = int("".join("01"[int(b)] for b in bits), 2)
    return value - (1 << 64) if value >> 63 else value


def hashed(images: DataFrame) -> DataFrame:
    """``hash`` of rows of the image source (``image`` struct); NULL where undecodable."""

    @F.pandas_udf("long")
    def of(w: pd.Series, h: pd.Series, n: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([dhash(int(a), int(b), int(c), d) for a, b, c, d in zip(w, h, n, data, strict=True)], dtype="Int64")

    return images.withColumn("hash", of("image.width", "image.height", "image.nChannels", "image.data"))
