"""Provider responses to category rows: one schema, NULL where there is no score.

Every function takes frames with a ``response`` JSON column and returns one row for each label:
the frame's columns, ``cat_ord``, ``category``, ``provider_label``, ``score``, ``score_origin``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def canonical(category: Column) -> Column:
    """An unknown category is OTHER."""
    return F.when(category.isin(*S.CATEGORIES), category).otherwise(F.lit("OTHER"))


def is_provenance(category: Column) -> Column:
    return category.isin(*S.PROVENANCE)


def severity(frames: DataFrame) -> DataFrame:
    """Severity in six steps as a share of the highest."""
    parsed = frames.withColumn("_r", F.from_json("response", S.SEVERITY_RESPONSE)).drop("response")
    rows = parsed.select("*", F.posexplode("_r.categoriesAnalysis").alias("cat_ord", "_c")).drop("_r")
    category = F.coalesce(F.try_element_at(_map(S.SEVERITY_CATEGORIES), F.col("_c.category")), F.lit("OTHER"))
    return rows.select("*", category.alias("category"), F.col("_c.category").alias("provider_label"), (F.col("_c.severity") / F.lit(6.0)).alias("score"), F.lit("severity").alias("score_origin")).drop("_c")


def likelihood(frames: DataFrame, scores: dict[str, float] | None = None) -> DataFrame:
    """Named likelihoods; UNKNOWN and unlisted names have no score. ``scores`` overrides."""
    table = {k.upper(): float(v) for k, v in {**S.LIKELIHOOD_SCORES, **(scores or {})}.items()}
    parsed = frames.withColumn("_r", F.from_json("response", S.LIKELIHOOD_RESPONSE)).drop("response")
    fields = F.array(*[F.struct(F.lit(k).alias("field"), F.lit(c).alias("category"), F.col(f"_r.{k}").alias("value")) for k, c in S.LIKELIHOOD_CATEGORIES.items()])
    rows = parsed.select("*", F.posexplode(fields).alias("cat_ord", "_c")).drop("_r")
    score = F.when(F.col("_c.value") != "UNKNOWN", F.try_element_at(_map(table), F.col("_c.value")))
    return rows.select("*", F.col("_c.category").alias("category"), F.concat_ws(":", "_c.field", "_c.value").alias("provider_label"), score.alias("score"), F.lit("likelihood_enum").alias("score_origin")).drop("_c")


def heads(frames: DataFrame, class_map: DataFrame) -> DataFrame:
    """The first output's heads, mapped by lower-cased label (label_lc, category); none dropped."""
    parsed = frames.withColumn("_o", F.get(F.get(F.from_json("response", S.HEADS_RESPONSE)["status"], F.lit(0))["response"]["output"], F.lit(0))).drop("response")
    rows = parsed.select("*", F.posexplode("_o.classes").alias("cat_ord", "_c")).drop("_o")
    rows = rows.select("*", F.col("_c.class").alias("provider_label"), F.col("_c.score").alias("score"), F.lit("probability").alias("score_origin")).drop("_c")
    known = class_map.select(F.col("label_lc").alias("_label"), canonical(F.col("category")).alias("_category"))
    return rows.join(known, F.lower("provider_label") == F.col("_label"), "left").withColumn("category", F.coalesce("_category", F.lit("OTHER"))).drop("_label", "_category")


def class_map(builtin: DataFrame, overrides: DataFrame) -> DataFrame:
    """the built-in map (label_lc, category) with a run's overrides (label, category) on top."""
    own = overrides.select(F.lower("label").alias("label_lc"), canonical(F.upper("category")).alias("category")).dropDuplicates(["label_lc"])
    return builtin.join(own.select("label_lc"), "label_lc", "left_anti").unionByName(own)


def yes_probability(top: Column) -> Column:
    """P5: P(yes) / (P(yes) + P(no)) of the first token's alternatives; NULL if one is missing or
    the result is no number."""
    pick = lambda word: F.get(F.filter(top, lambda t: F.lower(F.trim(t["token"])) == word), F.lit(0))["logprob"]
    yes, no = F.exp(pick("yes")), F.exp(pick("no"))
    p = yes / (yes + no)
    return F.when(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def policies(frames: DataFrame) -> DataFrame:
    """P5, P6/S6d: one response for each (frame, ``policy``). If any policy of a frame has no
    score, the whole frame is an error and loses its scores."""
    parsed = frames.withColumn("_r", F.from_json("response", S.LOGPROB_RESPONSE)).drop("response")
    top = F.get(F.get(F.col("_r.choices"), F.lit(0))["logprobs"]["content"], F.lit(0))["top_logprobs"]
    scored = parsed.withColumn("score", yes_probability(top)).drop("_r")
    whole = scored.groupBy("asset_id", "frame_idx").agg(F.max(F.col("score").isNull()).alias("_bad"))
    category = F.coalesce(F.try_element_at(_map(S.POLICIES), F.col("policy")), F.lit("OTHER"))
    out = scored.join(whole, ["asset_id", "frame_idx"])
    return out.withColumn("status", F.when(F.col("_bad"), F.lit("error")).otherwise(F.col("status"))).withColumn("score", F.when(~F.col("_bad"), F.col("score"))).select(
        "*", category.alias("category"), F.col("policy").alias("provider_label"), F.lit("probability").alias("score_origin")
    ).drop("_bad")
