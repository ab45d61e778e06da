"""Frames to asset verdicts, envelopes' facts and dispositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def roll_up(frames: DataFrame, rows: DataFrame) -> DataFrame:
    """A1: one verdict for each asset, strictly block, error, flag, allow.

    ``frames``: (asset_id, frame_ord, status), at least one row for every asset, status NULL for an
    asset without frames (J6). ``rows``: category rows (asset_id, frame_ord, cat_ord, category,
    score, flag_at, block_at, flagged). Both are aggregated on asset_id, partially before the
    shuffle; nothing is collected but one row an asset. Rows that carry their frame's ``status``, as
    the normalisers' do, are filtered by it; others meet their frames in a join."""
    ok = F.col("status") == "ok"
    counted = frames.groupBy("asset_id").agg(F.count("status").alias("n_frames"), F.count_if(F.col("status") != "ok").alias("n_errors"), F.count_if(ok).alias("n_ok"))
    good = rows.filter(ok) if "status" in rows.columns else rows.join(frames.filter(ok).select("asset_id", "frame_ord"), ["asset_id", "frame_ord"], "left_semi")
    score = F.when(~F.isnan("score"), F.col("score"))
    first = F.struct(score.alias("s"), (-F.col("frame_ord")).alias("f"), (-F.col("cat_ord")).alias("c"))
    best = good.groupBy("asset_id").agg(
        F.max(F.coalesce(score >= F.col("block_at"), F.lit(False))).alias("blocked"),
        F.max(F.col("flagged")).alias("flagged"),
        F.max(score).alias("max_score"),
        F.max_by(F.when(score.isNotNull(), F.col("category")), F.when(score.isNotNull(), first)).alias("top_category"),
        F.max(F.isnan("score")).alias("_nan"),
    )
    out = counted.join(best, "asset_id", "left")
    verdict = (
        F.when(F.coalesce("blocked", F.lit(False)), "block")
        .when((F.col("n_errors") > 0) | (F.col("n_ok") == 0) | F.col("max_score").isNull() | F.coalesce("_nan", F.lit(False)), "error")
        .when(F.col("flagged"), "flag")
        .otherwise("allow")
    )
    return out.select("asset_id", verdict.alias("verdict"), F.coalesce("flagged", F.lit(False)).alias("flagged"), "top_category", "max_score", F.col("max_score").alias("confidence"), "n_frames", "n_errors")


def with_zero_frames(assets: DataFrame, frames: DataFrame) -> DataFrame:
    """Every asset, its frames or one row of NULLs."""
    return assets.join(frames, "asset_id", "left")


def error_frame() -> Column:
    """The single frame of an asset without frames."""
    return F.array(F.struct(F.lit(None).cast("double").alias("timestamp_sec"), F.lit("error").alias("status"), F.lit("no frames could be extracted").alias("error"), F.array().cast(f"array<{S.CATEGORY}>").alias("categories")))


def empty_videos(assets: DataFrame, skip: bool) -> DataFrame:
    """Assets (job_id, media_type, n_frames) without frames: ``outcome`` is skip for videos
    when skipping is on (an audit event and no verdict), error otherwise."""
    return assets.filter("n_frames = 0").withColumn("outcome", F.when((F.col("media_type") == "video") & F.lit(skip), "skip").otherwise("error"))


def stamp(jobs: DataFrame) -> DataFrame:
    """Asset id (the ref, else the job id), schema version, media type."""
    ref = F.nullif(F.col("ref"), F.lit(""))
    return jobs.withColumn("asset_id", F.coalesce(ref, "job_id")).withColumn("schema_version", F.lit(S.VERSION)).withColumn("media_type", F.coalesce(F.nullif(F.col("media_type"), F.lit("")), F.lit("image")))


def error_text(verdict: Column, processing: Column, frames: Column) -> Column:
    """The job's error, only for the verdict error; ``frames`` is array<struct<status,error>>."""
    texts = F.filter(frames, lambda f: (f["status"] == "error") & f["error"].isNotNull())
    joined = F.nullif(F.array_join(F.transform(texts, lambda f: f["error"]), "; "), F.lit(""))
    return F.when(verdict == "error", F.coalesce(F.nullif(processing, F.lit("")), joined, F.lit("could not evaluate")))


def disposition(sink_ok: Column, audit_ok: Column, verdict: Column) -> Column:
    """What happens to the job next."""
    return F.when(~sink_ok, "retry").when(~audit_ok, "dead_letter").when(verdict == "error", "dead_letter").otherwise("ack")


def job_records(envelopes: DataFrame) -> DataFrame:
    """Operations view of envelopes with a ``disposition``; retries are not recorded."""
    frames = F.col("result.frames")
    flagged = F.filter(frames, lambda f: F.exists(f["categories"], lambda c: c["flagged"]))
    verdict = F.when(F.col("disposition") != "ack", "error").when(F.col("result").isNull(), "skip").otherwise(F.col("result.overall.verdict"))
    return envelopes.filter("disposition <> 'retry'").select(
        "job_id", F.col("source.ref").alias("ref"), F.col("source.media_type").alias("media_type"), verdict.alias("verdict"), F.col("result.overall.top_category").alias("top_category"), F.col("result.overall.max_score").alias("max_score"),
        F.coalesce(F.when(frames.isNotNull(), F.size(frames)), F.lit(0)).alias("frames_scanned"), F.coalesce(F.when(frames.isNotNull(), F.size(flagged)), F.lit(0)).alias("frames_flagged"),
        (F.unix_millis("finished_at") - F.unix_millis("started_at")).alias("duration_ms"), "finished_at",
    )


def raw_digest(frames: DataFrame) -> DataFrame:
    """(asset_id, raw_sha256) of frames (asset_id, media_type, ts, frame_ord, raw): an image's
    response itself, a video's JSON array in time order with null for failed frames, and the empty
    string where no frame has a response."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("ts").isNull().alias("n"), "ts", "frame_ord", F.coalesce("raw", F.lit("null")).alias("raw"))))
    grouped = frames.groupBy("asset_id", "media_type").agg(ordered.alias("o"), F.count("raw").alias("n"))
    texts = F.transform("o", lambda x: x["raw"])
    evidence = F.when(F.col("media_type") == "image", F.get(texts, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")))
    return grouped.select("asset_id", F.when(F.col("n") == 0, "").otherwise(F.sha2(evidence, 256)).alias("raw_sha256"))


def outcome(records: DataFrame) -> DataFrame:
    """A10: 2 if any job was not acked, else 1 if any verdict is not allow, else 0."""
    return records.agg(F.max(F.when(F.col("disposition") != "ack", 2).when(F.col("verdict") != "allow", 1).otherwise(0)).alias("run_outcome"))


def envelopes(jobs: DataFrame, verdicts: DataFrame, frames: DataFrame, rows: DataFrame, adapter: str, model_version: str, config: Column) -> DataFrame:
    """Nested envelopes of ``jobs`` (job_id, ref, ref_digest, kind, media_type, metadata,
    started_at, finished_at): frames in time order, categories in response order."""
    categories = rows.groupBy("asset_id", "frame_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("cat_ord", F.struct("category", "provider_label", "score", "score_origin", "threshold", "flagged").alias("c")))), lambda x: x["c"]).alias("categories"))
    with_rows = frames.join(categories, ["asset_id", "frame_ord"], "left")
    none = F.array().cast(f"array<{S.CATEGORY}>")
    one = F.struct(F.col("timestamp_sec"), "status", "error", F.when(F.col("status") == "ok", F.coalesce("categories", none)).otherwise(none).alias("categories"))
    framed = with_rows.groupBy("asset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("timestamp_sec").isNull().alias("n"), "timestamp_sec", "frame_ord", one.alias("f")))), lambda x: x["f"]).alias("frames"))
    all_ = stamp(jobs).join(verdicts, "asset_id").join(framed, "asset_id", "left")
    overall = F.struct("verdict", "flagged", "top_category", "max_score", "confidence")
    result = F.struct("schema_version", F.lit(adapter).alias("provider"), F.lit(model_version).alias("model_version"), "media_type", "asset_id", F.coalesce("frames", error_frame()).alias("frames"), overall.alias("overall"))
    text = error_text(F.col("verdict"), F.lit(None).cast("string"), F.transform(F.coalesce("frames", error_frame()), lambda f: F.struct(f["status"].alias("status"), f["error"].alias("error"))))
    return all_.select(
        "job_id", F.struct("kind", "ref", "ref_digest", "media_type").alias("source"), F.struct(F.lit(adapter).alias("adapter"), F.lit(model_version).alias("model_version"), config.alias("config_hash")).alias("model_id"),
        result.alias("result"), text.alias("error"), "metadata", "started_at", "finished_at",
    )
