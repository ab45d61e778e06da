"""Quantiles over buckets and sketches, and rates of frames."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from modsieve.operators import ops
from modsieve.streaming import batch as B

T0 = dt.datetime(2024, 1, 1)


def quantile(bars, q):
    """By hand: the first bucket that reaches the rank, between its edges."""
    total, before, low = bars[-1][1], 0, 0.0
    for le, n in bars:
        if n >= q * total:
            return low if le == float("inf") else le if n == before else low + (le - low) * (q * total - before) / (n - before)
        before, low = n, le


def test_bucket_quantiles_by_hand(spark):
    g = np.random.default_rng(1)
    rows = [(k, float(v)) for k in "abc" for v in g.exponential({"a": 3, "b": 40, "c": 900}[k], 200)]
    edges = [1, 2, 4, 8, 16, 32, 64, 128]
    bars = ops.histogram(spark.createDataFrame(rows, "k string, v double"), "v", edges, "k")
    got = {r.k: (r.p50, r.p95) for r in ops.bucket_quantiles(bars, "k").collect()}
    for k in "abc":
        own = [v for x, v in rows if x == k]
        counts = [(float(e), sum(v <= e for v in own)) for e in edges] + [(float("inf"), len(own))]
        assert np.allclose(got[k], [quantile(counts, 0.5), quantile(counts, 0.95)])
    twice = ops.bucket_quantiles(bars.unionByName(bars), "k")
    assert {r.k: (r.p50, r.p95) for r in twice.collect()} == got
    none = spark.createDataFrame([("x", None)], "k string, v double")
    assert [tuple(r) for r in ops.bucket_quantiles(ops.histogram(none, "v", edges, "k"), "k").collect()] == [("x", None, None)]
    assert ops.bucket_quantiles(bars.limit(0), "k").count() == 0


def test_sketches_merge_and_stay_near(spark):
    g = np.random.default_rng(2)
    rows = [(f"a{i % 2}", T0 + dt.timedelta(seconds=int(i % 7200)), None if i % 50 == 0 else float(v)) for i, v in enumerate(g.normal(100, 30, 20000))]
    stored = ops.sketches(spark.createDataFrame(rows, "k string, at timestamp, v double"), "v", "k", "at")
    assert stored.count() == 2 * 120 and stored.agg(F.max(F.length("sketch"))).first()[0] < 20000
    for r in ops.sketched_quantiles(stored, "k").collect():
        own = np.sort([v for k, _, v in rows if k == r.k and v is not None])
        assert r.n == len(own)
        for q, v in ((0.5, r.p50), (0.95, r.p95)):
            assert abs(np.searchsorted(own, v) / len(own) - q) < 0.02
    plan = ops.sketched_quantiles(stored, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan


def test_rates_of_frames(spark):
    rows = [("allow", "video", 10, T0), ("error", "video", None, T0 + dt.timedelta(seconds=59)), ("allow", "image", 1, T0 + dt.timedelta(seconds=60))]
    d = spark.createDataFrame(rows, "verdict string, media_type string, frames_scanned long, finished_at timestamp")
    assert sorted(map(tuple, B.frame_rates(d).collect())) == [(T0, 10 / 60, 1 / 60), (T0 + dt.timedelta(minutes=1), 1 / 60, 0.0)]
    got = {(r.window_start, r.media_type): (r.jobs, r.mean_frames, r.most_frames) for r in B.frames_per_job(d).collect()}
    assert got[T0, "video"] == (2, 5.0, 10) and got[T0, "image"] == (1, 1.0, 1) and got[T0 - dt.timedelta(minutes=4), "video"] == (2, 5.0, 10) and len(got) == 10
