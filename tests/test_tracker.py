"""The live tracker equals its batch twins after every micro-batch."""

from __future__ import annotations

import datetime as dt
import random

from modsieve.operators import ops
from modsieve.sources import commits
from modsieve.streaming import tracker

T0 = dt.datetime(2024, 1, 1)
RECORDS = "job_id string, finished_at timestamp, verdict string"
EVENTS = "key string, state string, at timestamp, seq long"


def stream(spark, schema, src):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_the_ring_equals_recent_after_every_batch(spark, tmp_path):
    g, src, path, cp = random.Random(1), str(tmp_path / "in"), str(tmp_path / "ring"), str(tmp_path / "cp")
    seen = []
    for b in range(4):
        part = [(None if g.random() < 0.02 else f"job-{b}-{i}", None if g.random() < 0.1 else T0 + dt.timedelta(seconds=g.randrange(60)), g.choice(["allow", "block", None])) for i in range(120)]
        seen += part
        spark.createDataFrame(part, RECORDS).coalesce(1).write.mode("append").parquet(src)
        q = tracker.ring(stream(spark, RECORDS, src), path, 15).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination(180)
        want = ops.recent(spark.createDataFrame(seen, RECORDS), 15)
        got = tracker.tracked(spark, path, want.schema)
        assert [r[:2] for r in got.collect()] == [r[:2] for r in want.collect()] and got.count() == 15
    files = lambda: len(list((tmp_path / "ring").glob("*.parquet")))
    assert files() == 4
    commits.vacuum(spark, path, -1)  # what snapshots stand for goes
    assert files() == 1 and tracker.tracked(spark, path, want.schema).count() == 15


def test_a_record_that_cannot_be_recent_does_not_pass(spark, tmp_path):
    src = str(tmp_path / "in")
    for b in (10, 0):  # the second batch is older than all of the first
        rows = [(f"job-{b}-{i}", T0 + dt.timedelta(hours=b, seconds=i), "allow") for i in range(300)]
        spark.createDataFrame(rows, RECORDS).coalesce(1).write.mode("append").parquet(src)
    q = tracker.recent(stream(spark, RECORDS, src), 5, 4).writeStream.format("memory").queryName("passing").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    rows = spark.table("passing").collect()
    assert len(rows) == 20 and all(r.job_id.startswith("job-10-") for r in rows)


def test_latest_and_depths_equal_the_batch(spark, tmp_path):
    g, src, path, cp = random.Random(2), str(tmp_path / "in"), str(tmp_path / "depths"), str(tmp_path / "cp")
    seen, n = [], 0
    for _ in range(3):
        part = []
        for _ in range(80):
            n += 1
            part.append((g.choice(["a", "b", "c", "d", "e", "f", None]), g.choice(["queued", "claimed", "done", None]), T0 + dt.timedelta(seconds=g.randrange(500)), n))
        seen += part
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(src)
        q = tracker.depths(stream(spark, EVENTS, src), path).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination(180)
        want = ops.latest(spark.createDataFrame(seen, EVENTS), "key", "state", "at", "seq").groupBy("state").count()
        assert sorted(map(tuple, tracker.depths_now(spark, path).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    version = commits.state(spark, path).version
    tracker.depths(stream(spark, EVENTS, src), path).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination(180)
    assert commits.state(spark, path).version == version  # nothing new, nothing written
