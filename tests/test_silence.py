"""Instances that fall silent are told without any further heartbeat."""

from __future__ import annotations

import datetime as dt
import time

from modsieve.streaming import live

T0 = dt.datetime(2024, 1, 1)


def test_all_instances_of_a_dead_stream_are_told(spark, tmp_path):
    src, taken = str(tmp_path / "beats"), []
    rows = [(k, T0 + dt.timedelta(seconds=s)) for k in ("i1", "i2", None) for s in (0, 20, 10)] + [("i3", None)]
    spark.createDataFrame(rows, "instance_id string, at timestamp").coalesce(1).write.parquet(src)
    claims = spark.createDataFrame([("a", "i1"), ("b", "i2"), ("c", "other"), ("d", "i2")], "job_id string, instance_id string")
    beats = spark.readStream.schema("instance_id string, at timestamp").parquet(src)
    told = live.silent(beats, 2).writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    took = live.reclaim(beats, lambda: claims, lambda d: taken.extend(r.job_id for r in d.collect()), 2).option("checkpointLocation", str(tmp_path / "cp2")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and (spark.table("silent").count() < 4 or len(taken) < 3):
            assert told.exception() is None and took.exception() is None
            time.sleep(1)
        time.sleep(3)
        got = {r.instance_id: (r.stale_at, r.beats) for r in spark.table("silent").collect()}
        assert got == {k: (T0 + dt.timedelta(seconds=22), 3) for k in ("i1", "i2", None)} | {"i3": (None, 1)}
        assert spark.table("silent").count() == 4 and sorted(taken) == ["a", "b", "d"]
    finally:
        told.stop()
        took.stop()
