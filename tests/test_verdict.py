from __future__ import annotations

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modsieve.operators import thresholds as T
from modsieve.operators import verdict as V

ROW = "asset_id string, frame_ord long, cat_ord int, category string, provider_label string, score double"
FRAME = "asset_id string, frame_ord long, status string"


def roll(spark, frames, rows, table=None):
    t = spark.createDataFrame(table, T.SCHEMA) if table else T.defaults(spark)
    r = T.apply(T.resolve(spark.createDataFrame(rows, ROW), t))
    return {x.asset_id: x for x in V.roll_up(spark.createDataFrame(frames, FRAME), r).collect()}


def test_precedence_and_nulls(spark):
    frames = [("allow", 0, "ok"), ("flag", 0, "ok"), ("block", 0, "ok"), ("block", 1, "error"), ("error", 0, "ok"), ("error", 1, "error"), ("null", 0, "ok"), ("none", None, None), ("nan", 0, "ok"), ("bad", 0, "error")]
    rows = [("allow", 0, 0, "HATE", "h", 0.1), ("flag", 0, 0, "SEXUAL", "s", 0.45), ("flag", 0, 1, "VIOLENCE", "v", 0.45), ("block", 0, 0, "HATE", "h", 0.9), ("error", 0, 0, "HATE", "h", 0.1), ("null", 0, 0, "HATE", "h", None), ("nan", 0, 0, "HATE", "h", float("nan")), ("bad", 0, 0, "HATE", "h", 0.99)]
    got = roll(spark, frames, rows)
    assert {k: v.verdict for k, v in got.items()} == {"allow": "allow", "flag": "flag", "block": "block", "error": "error", "null": "error", "none": "error", "nan": "error", "bad": "error"}
    assert got["null"].max_score is None and got["null"].top_category is None
    assert got["flag"].top_category == "SEXUAL"  # the first of equal scores
    assert got["bad"].max_score is None and not got["bad"].flagged


def test_label_beats_category_field_by_field(spark):
    table = [("default", 0.5, 0.8), ("SEXUAL", 0.4, 0.7), ("label:yes_genitals", None, 0.5), ("label:no_gun", 0.99, None)]
    frames = [("a", 0, "ok"), ("b", 0, "ok")]
    rows = [("a", 0, 0, "SEXUAL", "Yes_Genitals", 0.55), ("b", 0, 0, "WEAPONS", "no_gun", 0.85)]
    got = roll(spark, frames, rows, table)
    assert got["a"].verdict == "block" and got["a"].flagged
    assert got["b"].verdict == "block" and not got["b"].flagged


def test_override_drops_category_rows(spark):
    labels = spark.createDataFrame([("gun", 0.5, 0.9)], T.SCHEMA)
    assert {r.key for r in T.merge(T.defaults(spark), labels, "override").collect()} == {"label:gun"}
    with pytest.raises(ValueError, match="unknown mode"):
        T.merge(T.defaults(spark), labels, "sometimes")


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["ok", "error"]), st.lists(st.one_of(st.none(), st.floats(0, 1)), max_size=3)), min_size=1, max_size=5))
def test_no_failure_becomes_allow(spark, spec):
    frames = [("a", i, s) for i, (s, _) in enumerate(spec)]
    rows = [("a", i, j, "HATE", "h", x) for i, (_, xs) in enumerate(spec) for j, x in enumerate(xs)] or [("z", 0, 0, "HATE", "h", 0.0)]
    got = roll(spark, frames, rows)["a"]
    again = roll(spark, frames[::-1], rows[::-1])["a"]
    assert got == again
    if any(s == "error" for s, _ in spec):
        assert got.verdict in ("block", "error")
    scores = [x for s, xs in spec if s == "ok" for x in xs if x is not None]
    assert got.max_score == (max(scores) if scores else None)


def test_disposition_and_run_outcome(spark):
    cases = list(itertools.product([True, False], [True, False], ["allow", "block", "error"]))
    df = spark.createDataFrame(cases, "s boolean, a boolean, verdict string")
    rows = df.withColumn("disposition", V.disposition(F.col("s"), F.col("a"), F.col("verdict"))).collect()
    want = {(s, a, v): "retry" if not s else "dead_letter" if not a or v == "error" else "ack" for s, a, v in cases}
    assert {(r.s, r.a, r.verdict): r.disposition for r in rows} == want


def test_overrides_of_maps_and_scores(spark):
    from modsieve.functions import normalize as N
    from modsieve.plans import fixtures as X

    own = spark.createDataFrame([("Gun_In_Hand", "violence"), ("new_head", "nonsense")], "label string, category string")
    got = {r.label_lc: r.category for r in N.class_map(X.class_map(spark), own).collect()}
    assert (got["gun_in_hand"], got["new_head"], got["yes_nazi"]) == ("VIOLENCE", "OTHER", "HATE") and len(got) == 60
    f = spark.createDataFrame([("a", '{"adult":"LIKELY","racy":"UNKNOWN"}')], "asset_id string, response string")
    rows = {r.provider_label: r.score for r in N.likelihood(f, {"likely": 0.9}).collect()}
    assert rows["adult:LIKELY"] == 0.9 and rows["racy:UNKNOWN"] is None
