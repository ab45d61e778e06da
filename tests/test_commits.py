"""Whole commits: stopped and concurrent writers, claims with releases, audits that are replayed."""

from __future__ import annotations

import datetime as dt
import json
import threading

import pytest
from pyspark.sql import functions as F

from modsieve.operators import audit
from modsieve.sources import commits, sinks
from modsieve.streaming import batch as B
from modsieve.streaming import live

T0 = dt.datetime(2024, 1, 1)
AUDIT_ROWS = "chain_id long, kind string, ord long, timestamp string, payload map<string,string>"


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def stored(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("job_id", "finished_at").collect())


def jobs(spark, rows):
    return spark.createDataFrame([(j, at(m)) for j, m in rows], "job_id string, finished_at timestamp")


def test_rows_without_a_time_are_written_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        sinks.append_once(jobs(spark, [("a", None), ("b", None)]), path)
    sinks.append_once(jobs(spark, [("a", 5), ("c", 5), ("d", None)]), path)
    sinks.append_once(jobs(spark, [("c", None)]), path)
    assert sorted(r.job_id for r in spark.read.parquet(path).collect()) == ["a", "b", "c", "d"]


def test_a_stopped_writer_leaves_nothing_or_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.append_once(jobs(spark, [("a", 1)]), path)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # before the entry
        m.setattr(commits._Files, "create", stop)
        with pytest.raises(KeyboardInterrupt):
            sinks.append_once(jobs(spark, [("b", 2)]), path)
    assert stored(spark, path) == [("a", at(1))] and commits.committed(spark, path).count() == 1
    moved = []

    def halfway(self, source, target, move=commits._Files.move):
        if moved:
            raise KeyboardInterrupt
        moved.append(move(self, source, target))

    with monkeypatch.context() as m:  # after the entry, one file moved
        m.setattr(commits._Files, "move", halfway)
        with pytest.raises(KeyboardInterrupt):
            sinks.append_once(jobs(spark, [("b", 2), ("c", 2000), ("d", 4000)]), path)
    sinks.append_once(jobs(spark, [("b", 3), ("d", 4001), ("e", 5)]), path)
    assert [j for j, _ in stored(spark, path)] == ["a", "b", "c", "d", "e"]
    assert commits.committed(spark, path).count() == 5 and commits.vacuum(spark, path, -1) > 0
    sinks.append_once(jobs(spark, [("e", 6), ("f", 5)]), path)
    assert [j for j, _ in stored(spark, path)] == ["a", "b", "c", "d", "e", "f"]


def test_two_writers_at_a_time(spark, tmp_path):
    path = str(tmp_path / "t")
    failed = []

    def write(k):
        try:
            sinks.append_once(jobs(spark, [("both", 1), (f"own{k}", 1)]), path)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and [j for j, _ in stored(spark, path)] == ["both", "own0", "own1", "own2"]


def test_readers_see_whole_commits(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append_once(jobs(spark, [("a", 1), ("b", 1)]), path)
    rows = commits.committed(spark, path)
    sinks.append_once(jobs(spark, [("c", 1)]), path)
    assert rows.count() == 2 and commits.committed(spark, path).count() == 3
    assert commits.committed(spark, str(tmp_path / "none")) is None


DELIVERIES = [("a", m) for m in (0, 50, 100, 170)] + [("b", 0), ("b", 60), ("b", 61), ("b", 121), ("b", 122), ("c", 10), ("c", 15), ("c", 400), ("z", 1000)]


def drained(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    return stream.sparkSession.table(name)


def fed(spark, tmp_path, name, rows, files):
    """A stream of one file a micro-batch."""
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        jobs(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema("job_id string, finished_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


@pytest.mark.parametrize("files", [1, 13])
def test_streamed_claims_equal_the_batch(spark, tmp_path, files):
    rows = sorted(DELIVERIES, key=lambda r: r[1]) if files > 1 else DELIVERIES
    got = drained(live.claims(fed(spark, tmp_path, "d", rows, files), "finished_at"), tmp_path, f"claims{files}")
    want = B.claims(jobs(spark, DELIVERIES))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sorted((r.finished_at - T0).total_seconds() / 60 for r in want.filter("job_id = 'a'").collect()) == [0, 100, 170]


def test_released_claims_pass_again(spark, tmp_path):
    rows, free = [("a", 0), ("a", 10), ("a", 20), ("b", 0), ("b", 5), ("a", 80), ("a", 90)], [("a", 10), ("c", 1), ("b", None), ("a", 85)]
    want = [("a", 0), ("a", 20), ("a", 90), ("b", 0)]
    got = B.claims(jobs(spark, rows), releases=jobs(spark, free))
    assert sorted(map(tuple, got.collect())) == [(j, at(m)) for j, m in want]
    streamed = live.claims(fed(spark, tmp_path, "d", rows, 1), "finished_at", releases=fed(spark, tmp_path, "f", free, 1))
    assert sorted(map(tuple, drained(streamed, tmp_path, "released").collect())) == [(j, at(m)) for j, m in want]


def test_deliveries_without_a_time_or_id(spark):
    rows = jobs(spark, [(None, 0), (None, 5), ("a", None), ("a", 1), ("a", None), ("a", 2), (None, None)])
    got = sorted(map(str, map(tuple, B.claims(rows).collect())))
    assert got == sorted(map(str, [(None, at(0)), ("a", None), ("a", at(1)), ("a", None), (None, None)]))


def events(spark, rows):
    return spark.createDataFrame([(c, k, o, f"t{o}", {"job_id": j} if j else {"x": str(o)}) for c, k, o, j in rows], AUDIT_ROWS)


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    log, heads = str(tmp_path / "log"), str(tmp_path / "heads")
    first = events(spark, [(1, "event", 0, None), (1, "decision", 1, "j1"), (2, "event", 2, None)])
    for _ in range(2):
        live.audit_batch(first, log, heads, ("q", 0))
    live.audit_batch(events(spark, [(1, "event", 3, None), (3, "event", 4, None)]), log, heads, ("q", 1))
    live.audit_batch(first, log, heads, ("q", 0))
    live.audit_batch(events(spark, [(1, "decision", 5, "j1")]), log, heads, ("other", 0))
    stored_ = spark.read.parquet(log)
    assert sorted(map(tuple, audit.verify(stored_).collect())) == [(1, None, 3), (2, None, 1), (3, None, 1)]
    assert sorted((r.chain_id, r.seq) for r in audit.heads_of(spark.read.parquet(heads)).collect()) == [(1, 3), (2, 1), (3, 1)]


def test_a_replayed_stream_adds_nothing(spark, tmp_path, monkeypatch):
    log, heads, src = (str(tmp_path / x) for x in ("log", "heads", "src"))
    events(spark, [(1, "event", 0, None), (1, "event", 1, None)]).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(AUDIT_ROWS).parquet(src)

    def run(failing):
        def each(df, _):
            live.audit_batch(df, log, heads)
            if failing:
                raise ValueError("stopped after the record")

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="stopped after"):
        run(True).awaitTermination(200)
    run(False).awaitTermination(200)
    assert [tuple(r) for r in audit.verify(spark.read.parquet(log)).collect()] == [(1, None, 2)]


def test_only_what_follows_the_frontier_is_read(spark, tmp_path, monkeypatch):
    log, heads = str(tmp_path / "log"), str(tmp_path / "heads")
    monkeypatch.setattr(live, "SNAPSHOT", 3)
    for b in range(6):
        live.audit_batch(events(spark, [(c, "event", 10 * b + k, None) for c in (1, 2) for k in range(10)]), log, heads, ("q", b))
    live.audit_batch(events(spark, [(9, "event", 0, None)]), log, heads, ("q", 6))
    tail, ends = live.audit_tail(spark, log, heads, spark.createDataFrame([(1,), (7,)], "chain_id long"))
    assert [(r.chain_id, r.seq) for r in tail.collect()] == [(1, 60)] and ends.first().log_version == 5
    assert {f.rsplit("/", 1)[1][:11] for f in tail.inputFiles() if "/log/" in f} == {"c0000000005"}
    # a stop between records and heads: they are read, verified and named by the next
    with monkeypatch.context() as m:
        m.setattr(live, "_store_heads", lambda *_: None)
        live.audit_batch(events(spark, [(2, "event", 90, None)]), log, heads, ("q", 7))
    tail, _ = live.audit_tail(spark, log, heads, spark.createDataFrame([(9,)], "chain_id long"))
    assert sorted((r.chain_id, r.seq) for r in tail.collect()) == [(2, 60), (2, 61), (9, 1)]
    live.audit_batch(events(spark, [(1, "event", 91, None)]), log, heads, ("q", 8))
    assert sorted(map(tuple, audit.verify(spark.read.parquet(log)).collect())) == [(1, None, 61), (2, None, 61), (9, None, 1)]
    assert sorted((r.chain_id, r.seq) for r in audit.heads_of(commits.read(spark, heads, live.HEADS)).collect()) == [(1, 61), (2, 61), (9, 1)]


@pytest.mark.parametrize("change, says", [("payload", "broken at 2"), ("hash", "rewritten"), ("tail", "broken at 3")])
def test_a_changed_end_is_refused(spark, tmp_path, change, says):
    log, heads, other = (str(tmp_path / x) for x in ("log", "heads", "other"))
    live.audit_batch(events(spark, [(1, "event", 0, None), (1, "event", 1, None)]), log, heads, ("q", 0))
    rows = spark.read.parquet(log)
    if change == "payload":
        rows = rows.withColumn("payload", F.when(F.col("seq") == 2, F.create_map(F.lit("x"), F.lit("?"))).otherwise(F.col("payload")))
    elif change == "hash":
        rows = rows.withColumn("entry_hash", F.when(F.col("seq") == 2, F.lit("0" * 64)).otherwise(F.col("entry_hash")))
    else:
        rows = rows.unionByName(rows.filter("seq = 2").withColumn("seq", F.lit(3).cast("long")))
    commits.append(spark, other, lambda _: rows)
    with pytest.raises(ValueError, match=says):
        live.audit_batch(events(spark, [(1, "event", 9, None)]), other, heads)


def test_a_refusal_is_told_in_the_dead_letter(spark, tmp_path):
    spark.createDataFrame([("a", "allow", at(1))], "job_id string, verdict string, at timestamp").write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema("job_id string, verdict string, at timestamp").parquet(str(tmp_path / "src"))

    def refuse(_):
        raise ValueError("audit chain 4 is truncated")

    process = lambda df: df.select("job_id", "verdict", F.col("at").alias("finished_at"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("attempts"), "at")
    live.moderate(stream, process, *(str(tmp_path / x) for x in ("store", "letters")), record=refuse, outcomes=str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)
    assert spark.read.parquet(str(tmp_path / "letters")).first().reason == "audit: audit chain 4 is truncated"
    assert json.loads((tmp_path / "store" / "_commits" / f"{0:010d}.json").read_text())["base"] == -1
