from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from modsieve.functions import admission as A
from modsieve.operators import audit, ops, scoring
from modsieve.plans import moderation as M
from modsieve.sources import readers, sinks
from modsieve.streaming import batch as B
from modsieve.streaming import live

T0 = dt.datetime(2024, 1, 1)


def at(s: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=s)


def feed(spark, tmp_path, df, name):
    """A file stream of ``df``, one file for each partition of it."""
    path = str(tmp_path / name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_envelope_members(spark):
    rows = sinks.envelope_json(M._envelopes(spark, "/root/testdata/sf0.001")).collect()
    for r in rows:
        e = json.loads(r.value)
        assert ("error" in e) == (e["result"]["overall"]["verdict"] == "error")
        assert "raw" not in r.value and "ref_digest" not in e["source"]
        assert all("score" in c and "threshold" in c for f in e["result"]["frames"] for c in f["categories"])
        assert "max_score" in e["result"]["overall"]


def test_append_once_is_durable(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 0)], "job_id string, finished_at int")
    sinks.append_once(df, str(tmp_path / "t"))
    sinks.append_once(df.unionByName(spark.createDataFrame([("c", 3)], df.schema)), str(tmp_path / "t"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 0), ("b", 2), ("c", 3)]


def test_fan_out_tries_all_and_raises_the_first(spark):
    seen = []

    def bad(_):
        seen.append("bad")
        raise ValueError("first")

    with pytest.raises(ValueError, match="first"):
        sinks.fan_out(spark.range(3), [("one", bad), ("two", lambda d: seen.append(d.count())), ("three", bad)])
    assert seen == ["bad", 3, "bad"]


def test_push(spark, tmp_path):
    folder = tmp_path / "got"
    folder.mkdir()

    def post(batch):
        import uuid

        (folder / uuid.uuid4().hex).write_text("\n".join(batch))

    sinks.push(M._envelopes(spark, "/root/testdata/sf0.001"), post, size=7)
    lines = [x for p in folder.iterdir() for x in p.read_text().split("\n")]
    assert len(lines) == M._envelopes(spark, "/root/testdata/sf0.001").count()


def test_scorer_registry_and_isolation(spark):
    with pytest.raises(KeyError, match="known: fake"):
        scoring.create("nobody")
    s = scoring.FakeScorer(response="{}", failing=("bad",))
    s.max_image_bytes = 5
    f = spark.createDataFrame([("ok", 0, b"x", 1), ("bad", 0, b"x", 1), ("big", 0, b"xxxxxx", 6)], "asset_id string, frame_idx long, content binary, n_bytes long")
    got = {r.asset_id: (r.status, r.error) for r in scoring.score_frames(f, s).collect()}
    assert got == {"ok": ("ok", None), "bad": ("error", "no answer for bad"), "big": ("error", "image is 6 bytes, over the limit of 5")}


def test_retries_and_pace():
    waits, calls = [], []

    def call():
        calls.append(1)
        raise scoring.Retry("no", 7 if len(calls) == 1 else 500)

    with pytest.raises(scoring.Retry):
        scoring.attempt(call, sleep=waits.append)
    assert waits == [7, 1.0] and len(calls) == 3
    now = [0.0]
    pace = scoring.Pace(2.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(5):
        pace.wait()
    assert now[0] == 2.0


def test_mime_and_addresses(spark):
    heads = {"image/png": "89504E470D0A1A0A00", "image/jpeg": "FFD8FFE000", "image/gif": "474946383961", "image/webp": "52494646AAAAAAAA57454250", "video/mp4": "0000001866747970", "video/webm": "1A45DFA3", "application/octet-stream": "0102"}
    df = spark.createDataFrame([(k, bytes.fromhex(v)) for k, v in heads.items()], "want string, content binary")
    assert df.filter(A.mime(F.col("content")) != F.col("want")).count() == 0
    cases = [("8.8.8.8", None, None), ("127.0.0.1", "loopback", None), ("::1", "loopback", None), ("::ffff:10.1.2.3", "private", None), ("fc00::1", "private", None), ("fe80::1", "link-local", "link-local"), ("169.254.169.254", "link-local", "link-local"), ("fd00:ec2::254", "private", "metadata"), ("100.64.0.1", "CGNAT", "CGNAT"), ("ff05::1", "multicast", "multicast"), ("::", "unspecified", "unspecified"), ("nonsense", "invalid", "invalid"), ("2001:4860::8888", None, None)]
    df = spark.createDataFrame(cases, "a string, s string, r string")
    bad = df.filter(~A.ip6_reason("strict")("a").eqNullSafe(F.col("s")) | ~A.ip6_reason("relaxed")("a").eqNullSafe(F.col("r")))
    assert bad.collect() == []
    quads = df.filter("a rlike '^[0-9.]+$'")
    assert quads.filter(~A.ip_reason(F.col("a")).eqNullSafe(F.col("s"))).count() == 0


def test_metadata_rules(spark):
    exact = '{"k":"' + "x" * (4096 - 8) + '"}'
    cases = [(None, None, None), ('{ "a" : 1.50 }', '{"a":1.50}', None), ('{"a b": "c  d"}', '{"a b":"c  d"}', None), ("{}", "{}", None), (exact, exact, None), (exact[:-2] + 'x"}', None, "too_large"), ("[1]", None, "not_object"), ("null", None, "not_object"), ('{"a":1} x', None, "invalid"), ('{"a":NaN}', None, "invalid")]
    df = spark.createDataFrame(cases, "m string, want string, why string")
    for r in df.select("*", A.metadata("m").alias("x")).collect():
        assert (r.x.metadata, r.x.reason) == (r.want, r.why)


def test_scores_of_other_origin_are_refused(spark):
    a = spark.createDataFrame([("k", 0.5, "probability")], "key string, score double, score_origin string")
    assert ops.score_difference(a, a).first().difference == 0
    with pytest.raises(Exception, match="different origin"):
        ops.score_difference(a, a.withColumn("score_origin", F.lit("severity"))).collect()


def test_pressure_machine():
    p = B.Pressure(n=3, m=2)
    assert [p.record(i, False) for i in range(3)] == [False, False, True]
    assert [p.record(4, True), p.record(5, True)] == [True, False]
    p = B.Pressure(n=50)
    states = [p.record(i, i % 2 == 0) for i in range(12)]
    assert not any(states[:9]) and states[9]
    assert not B.Pressure().record(0, False)


def test_streaming_pressure_and_ledger_match_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a" if i % 3 else "b", at(i), i, (i * 7) % 5 > 2) for i in range(80)], "adapter string, at timestamp, seq long, ok boolean")
    got = drain(live.backpressure(feed(spark, tmp_path, rows.coalesce(1), "o")), tmp_path, "pressure")
    want = B.backpressure(rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    tries = spark.createDataFrame([(f"j{j}", a, "retry" if a <= j else "ack", at(j * 10 + a)) for j in range(6) for a in range(1, j + 2)], "job_id string, attempt long, disposition string, at timestamp")
    got = drain(live.ledger(feed(spark, tmp_path, tries.coalesce(1), "l")), tmp_path, "ledger")
    assert sorted(map(str, got.collect())) == sorted(map(str, B.ledger(tries).collect()))


def test_streaming_redelivery_rates_liveness(spark, tmp_path):
    jobs = spark.createDataFrame([("a", at(0)), ("a", at(60)), ("b", at(90))], "job_id string, submitted_at timestamp")
    assert sorted(r.job_id for r in drain(live.once_an_hour(feed(spark, tmp_path, jobs.coalesce(1), "r")), tmp_path, "redelivery").collect()) == ["a", "b"]
    rec = spark.createDataFrame([("allow", at(1)), ("allow", at(2)), ("block", at(70)), ("allow", at(4000))], "verdict string, finished_at timestamp")
    got = {(r.verdict, r.window_start): r.per_second for r in drain(live.rates(feed(spark, tmp_path, rec.coalesce(1), "v")), tmp_path, "rates").collect()}
    assert got[("allow", T0)] == 2 / 60 and got[("block", at(60))] == 1 / 60
    beats = spark.createDataFrame([("i", at(0)), ("i", at(30)), ("k", at(1000))], "instance_id string, at timestamp")
    got = drain(live.liveness(feed(spark, tmp_path, beats.coalesce(1), "h")), tmp_path, "beats").collect()
    assert [(r.instance_id, r.stale_at, r.beats) for r in got] == [("i", at(90), 2)]


def _process(df):
    return df.select("job_id", "verdict", F.col("at").alias("finished_at"), F.lit("boom").alias("error"), F.lit(1).alias("attempts"), "at")


def _run(writer, tmp_path, name):
    writer.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)


def test_continuous_moderation(spark, tmp_path):
    jobs = spark.createDataFrame([(f"j{i}", "error" if i == 2 else "allow", at(i)) for i in range(4)] + [("j0", "allow", at(9))], "job_id string, verdict string, at timestamp")
    store, letters, outcomes = (str(tmp_path / x) for x in ("store", "letters", "outcomes"))
    audited = []
    writer = lambda name: live.moderate(feed(spark, tmp_path, jobs.coalesce(1), name), _process, store, letters, record=lambda d: audited.append(d.count()), outcomes=outcomes)
    _run(writer("a"), tmp_path, "cp-a")
    _run(writer("b"), tmp_path, "cp-b")  # the batch again: nothing is written twice
    assert sorted(r.job_id for r in spark.read.parquet(store).collect()) == ["j0", "j1", "j2", "j3"]
    assert [r.job_id for r in spark.read.parquet(letters).collect()] == ["j2"]
    assert sorted((r.job_id, r.disposition) for r in spark.read.parquet(outcomes).collect()) == [("j0", "ack"), ("j1", "ack"), ("j2", "dead_letter"), ("j3", "ack")]
    assert audited == [5, 5]


def test_a_failed_sink_means_retry_and_no_audit(spark, tmp_path):
    jobs = spark.createDataFrame([("a", "allow", at(1)), ("b", "error", at(2))], "job_id string, verdict string, at timestamp")
    store, letters, outcomes = (str(tmp_path / x) for x in ("store", "letters", "outcomes"))
    audited = []

    def bad(_):
        raise ValueError("full")

    _run(live.moderate(feed(spark, tmp_path, jobs.coalesce(1), "f"), _process, store, letters, [("bad", bad)], audited.append, outcomes), tmp_path, "cp")
    assert {(r.job_id, r.disposition) for r in spark.read.parquet(outcomes).collect()} == {("a", "retry"), ("b", "retry")}
    assert not audited and not (tmp_path / "letters").exists()
    assert spark.read.parquet(store).count() == 2  # the other sinks were tried
    with pytest.raises(Exception, match="full"):
        _run(live.moderate(feed(spark, tmp_path, jobs.coalesce(1), "g"), _process, store, letters, [("bad", bad)]), tmp_path, "cp2")
    last = str(tmp_path / "last")
    _run(live.moderate(feed(spark, tmp_path, jobs.coalesce(1), "h"), _process, store, letters, record=bad, outcomes=last), tmp_path, "cp3")
    assert {r.disposition for r in spark.read.parquet(last).collect()} == {"dead_letter"}


def test_the_audit_refuses_a_truncated_log(spark, tmp_path):
    rows = spark.createDataFrame([(1, "decision", i, f"t{i}", {"job_id": f"j{i % 3}"}) for i in range(5)], "chain_id long, kind string, ord long, timestamp string, payload map<string,string>")
    log, heads = str(tmp_path / "log"), str(tmp_path / "heads")
    stream = feed(spark, tmp_path, rows.repartition(2, "ord"), "d")
    _run(live.audit_append(stream, log, heads), tmp_path, "cp2")
    stored = spark.read.parquet(log)
    assert [tuple(r) for r in audit.verify(stored).collect()] == [(1, None, 3)]
    assert audit.heads_of(spark.read.parquet(heads)).first().seq == 3
    more = spark.createDataFrame([(1, "decision", 9, "t9", {"job_id": "j9"})], rows.schema)
    cut = str(tmp_path / "cut")
    stored.filter("seq < 2").write.parquet(cut)
    with pytest.raises(ValueError, match="truncated"):
        live.audit_batch(more, cut, heads)
    with pytest.raises(ValueError, match="truncated"):
        live.audit_batch(more, str(tmp_path / "gone"), heads)
    live.audit_batch(more, log, heads)
    assert [tuple(r) for r in audit.verify(spark.read.parquet(log)).collect()] == [(1, None, 4)]


def test_claims_are_not_renewed(spark):
    rows = [("a", at(60 * m)) for m in (0, 50, 100, 160, 161)] + [("b", at(0)), ("b", at(3600)), ("b", at(3601))]
    d = spark.createDataFrame(rows, "job_id string, finished_at timestamp")
    got = sorted((r.job_id, (r.finished_at - T0).total_seconds()) for r in B.claims(d).collect())
    assert got == [("a", 0), ("a", 6000), ("a", 9660), ("b", 0), ("b", 3601)]
    assert B.claims(d.limit(0)).count() == 0


def test_outages_do_not_depend_on_the_slices(spark):
    import random

    g = random.Random(3)
    rows, t = [], 0.0
    for i in range(900):
        t += g.choice([0, 1, 5, 30, 400])
        rows.append((f"a{i % 3}", at(t), i, g.random() > (0.9 if 200 < i < 420 else 0.3)))
    d = spark.createDataFrame(rows, "adapter string, at timestamp, seq long, ok boolean").repartition(3)
    want = {}
    for a in ("a0", "a1", "a2"):
        own = [r for r in rows if r[0] == a]
        best = run = 0
        worst = 0.0
        for k, r in enumerate(own):
            run = 0 if r[3] else run + 1
            best = max(best, run)
            near = [x for x in own if r[1] - dt.timedelta(seconds=60) < x[1] <= r[1]]
            if len(near) >= 3:
                worst = max(worst, sum(not x[3] for x in near) / len(near))
        want[a] = (best, worst)
    for length in (60, 300, 3600, 10**7):
        assert {r.adapter: (r.longest_run, r.worst_rate) for r in ops.outages(d, 60, 3, length).collect()} == want


def test_outages_of_dense_outcomes_are_running_sums(spark):
    """Frames with a moving start add up every window's rows again: work grows with the square of the density."""
    import random
    import re

    g = random.Random(5)
    rows = [("a", at(g.randrange(0, 240_000_000) / 1e6), i, g.random() > 0.4) for i in range(3000)] + [("a", at(120), 5000 + i, i % 2 == 0) for i in range(20)] + [("a", None, 9000 + i, False) for i in range(9)]
    d = spark.createDataFrame(rows, "adapter string, at timestamp, seq long, ok boolean").repartition(3)
    timed = [r for r in rows if r[1]]
    worst = 0.0
    for r in timed:
        near = [x for x in timed if r[1] - dt.timedelta(seconds=20) < x[1] <= r[1]]
        worst = max(worst, sum(not x[3] for x in near) / len(near)) if len(near) >= 5 else worst
    for length in (20, 60, 10**6):
        got = ops.outages(d, 20, 5, length)
        assert [r.worst_rate for r in got.collect()] == [worst]
        assert not re.search(r"specifiedwindowframe\(RangeFrame, -?[0-9]", got._jdf.queryExecution().analyzed().toString())


def test_no_category_row_is_shuffled_by_its_label(spark):
    for name in ("a1_verdict", "j1_thresholds", "p4_heads", "a1_verdict_heads"):
        plan = M.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        keys = [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.split("\n") if "hashpartitioning(" in line]
        assert not [k for k in keys if "label" in k or "category" in k.split(",")[0]], (name, keys)


def test_manifest_and_logs_from_files(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"id":"1","kind":"url","ref":"https://h.example/a.MP4?sig=x","metadata":"{}"}\n{"id":"2","kind":"file","ref":"/a/b.png","workflows":["keyframe"]}\n')
    got = {r.job_id: r for r in readers.read_manifest(spark, str(tmp_path / "m.json")).collect()}
    assert (got["1"].ref, got["1"].media_type, got["1"].workflows) == ("https://h.example/a.MP4", "video", ["interval"])
    assert got["1"].ref_digest and got["2"].ref_digest is None and got["2"].workflows == ["keyframe"]
    (tmp_path / "x.log").write_text("a pts_time:1.5 b\nc pts_time:0.25\n")
    from modsieve.operators import frames as FR

    logs = readers.extraction_logs(spark, str(tmp_path / "x.log")).withColumnRenamed("path", "asset_id")
    assert [r.timestamp_sec for r in FR.log_times(logs).orderBy("frame_idx").collect()] == [1.5, 0.25]
