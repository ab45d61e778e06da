"""Back-pressure by slices against the machine that goes through outcomes one by one."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from modsieve.streaming import batch as B

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "adapter string, at timestamp, seq long, ok boolean"


def outcomes(seed, n=700):
    g, rows = random.Random(seed), []
    for a in range(4):
        t, share = 0.0, 0.3
        for i in range(n):
            t += g.choice([0, 0, 0.5, 1, 3, 8, 40] + [700] * (g.random() < 0.02))
            if g.random() < 0.02:
                share = g.choice([0.02, 0.2, 0.45, 0.55, 0.95])
            rows.append((f"a{a}", T0 + dt.timedelta(seconds=t), i, g.random() > share))
    return rows


def machine(rows, n, m, rate, window, samples):
    own, out = {}, []
    for a, t, s, ok in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.append((a, t, s, own.setdefault(a, B.Pressure(n, m, rate, window, samples)).record((t - T0).total_seconds(), bool(ok))))
    return sorted(out)


@pytest.mark.parametrize("seed, n, m, rate, window, samples, slice_rows", [(1, 4, 2, 50.0, 60.0, 10, 25), (2, 20, 5, 50.0, 60.0, 10, 100), (3, 6, 1, 30.0, 20.0, 4, 40), (4, 3, 3, 90.0, 60.0, 2, 7), (5, 50, 4, 50.0, 60.0, 5, 10**6)])
def test_slices_equal_the_machine(spark, seed, n, m, rate, window, samples, slice_rows):
    rows = outcomes(seed)
    got = B.backpressure(spark.createDataFrame(rows, SCHEMA).repartition(5), n, m, rate, window, samples, slice_rows)
    want = machine(rows, n, m, rate, window, samples)
    assert sorted(map(tuple, got.collect())) == want and 0.05 < sum(r[3] for r in want) / len(want) < 0.95


def test_odd_outcomes(spark):
    rows = [("a", T0, 1, None), ("a", None, 2, False), ("a", T0, 3, False), (None, T0, 4, False)]
    got = {r.seq: r.tripped for r in B.backpressure(spark.createDataFrame(rows, SCHEMA), n=2).collect()}
    assert got == {1: False, 2: None, 3: True, 4: False}
    assert B.backpressure(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_adapter_is_many_tasks(spark):
    rows = [("a", T0 + dt.timedelta(seconds=i), i, i % 3 > 0) for i in range(4000)]
    slices = B._counted(spark.createDataFrame(rows, SCHEMA), 60_000_000, 100)
    assert slices.select("_s").distinct().count() > 25
    assert set(slices.agg({"_bad": "max", "_good": "max"}).first()) == {1, 2}
