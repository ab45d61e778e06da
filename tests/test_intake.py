"""Intake over time by slices, and live, against a loop over all events."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from modsieve.streaming import intake as I

T0 = dt.datetime(2024, 1, 1)
ARRIVALS = "queue string, at timestamp, seq long, job_id string, bad_request string"
CHANGES = "queue string, at timestamp, seq long, tripped boolean, paused boolean, letters long"
TAKEN = "queue string, at timestamp, seq long"


def given(seed, n=600):
    g = random.Random(seed)
    arrivals, changes, taken = [], [], []
    for q in ("a", "b", None):
        t = 0.0
        for i in range(n):
            t += g.choice([0, 0, 0.2, 1, 5])
            at, kind = T0 + dt.timedelta(seconds=t), g.random()
            if kind < 0.6:
                arrivals.append((q, at, i, f"{q}-{i}", g.choice([None] * 9 + ["kind"])))
            elif kind < 0.95:
                taken.append((q, at, i))
            else:
                changes.append((q, at, i, g.choice([None, True, False, False]), g.choice([None, True, False, False]), g.choice([None, 1, 2, -1])))
    return arrivals, changes, taken


def loop(arrivals, changes, taken, cap, buffer):
    rows = [(q or "", at, 2, seq, job, bad) for q, at, seq, job, bad in arrivals] + [(q or "", at, 1, seq, "", None) for q, at, seq in taken] + [(q or "", at, 0, seq, "", rest) for q, at, seq, *rest in changes]
    states, out = {}, {}
    for q, _, kind, _, job, x in sorted(rows, key=lambda r: r[:5]):
        s = states.setdefault(q, {"tripped": False, "paused": False, "letters": 0, "level": 0})
        if kind == 0:
            s["tripped"], s["paused"] = (now if now is not None else s[c] for c, now in zip(("tripped", "paused"), x[:2], strict=True))
            s["letters"] += x[2] or 0
        elif kind == 1:
            s["level"] = max(0, s["level"] - 1)
        else:
            why = "backpressure" if s["tripped"] else "paused" if s["paused"] else f"bad_request:{x}" if x else "dead_letters_full" if s["letters"] >= cap else "queue_full" if s["level"] >= buffer else None
            s["level"] += why is None
            out[job] = (why is None, why, s["level"])
    return out


def frames(spark, arrivals, changes, taken):
    return I.events(*(spark.createDataFrame(r, s).repartition(3) for r, s in ((arrivals, ARRIVALS), (changes, CHANGES), (taken, TAKEN))))


def told(df):
    rows = df.collect()
    out = {r.job_id: (r.accepted, r.reason, r.waiting) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed, cap, buffer, slice_rows", [(1, 5, 6, 17), (2, 1000, 3, 1), (3, 4, 12, 100), (4, 1000, 1, 7), (5, 3, 256, 10**6)])
def test_slices_equal_the_loop(spark, seed, cap, buffer, slice_rows):
    rows = given(seed)
    want = loop(*rows, cap, buffer)
    assert told(I.intake(frames(spark, *rows), cap, buffer, slice_rows)) == want
    assert 0.1 < sum(v[0] for v in want.values()) / len(want) < 0.95


def test_one_moment_is_many_slices(spark):
    arrivals = [("a", T0, i, f"a-{i}", None) for i in range(500)]
    taken = [("a", T0 - dt.timedelta(seconds=1), i) for i in range(20)]
    got = told(I.intake(frames(spark, arrivals, [], taken), 1000, 50, 20))
    assert got == loop(arrivals, [], taken, 1000, 50) and sum(v[0] for v in got.values()) == 50


def test_odd_events(spark):
    arrivals = [("a", None, 1, "x", None), (None, T0, 2, "y", None), ("a", T0, None, "z", ""), ("", T0, 1, "w", None)]
    changes = [("a", None, 1, True, None, 5), ("b", T0, 1, True, None, None)]
    got = told(I.intake(frames(spark, arrivals, changes, [(None, None, 1)])))
    assert got == {"x": (False, "bad_request:no time", None), "y": (True, None, 1), "z": (False, "bad_request:", 0), "w": (True, None, 1)}
    assert I.intake(frames(spark, [], [], [])).count() == 0


def test_live_equals_the_batch(spark, tmp_path):
    rows = given(9, 200)
    events = frames(spark, *rows).coalesce(1).orderBy("at", "kind", "seq").collect()
    src, schema = str(tmp_path / "in"), frames(spark, [], [], []).schema
    cut = len(events) // 3
    while events[cut].at == events[cut - 1].at:  # a moment's events come in one file
        cut += 1
    for part in (events[:cut], events[cut:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = I.live_intake(stream, 5, 6).writeStream.format("memory").queryName("intake").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert told(spark.table("intake")) == loop(*rows, 5, 6)
