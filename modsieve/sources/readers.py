"""Sources: manifests, media files, frame images, logs, envelopes and audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import admission as A


def manifest(rows: DataFrame, workflow: str = "interval") -> DataFrame:
    """Job rows of manifest rows, defaults filled: media type by extension, workflows, ref
    redacted for URLs with the digest of the whole."""
    ref, digest = A.redact(F.col("ref"))
    url = F.col("kind") == "url"
    shown = F.when(url, ref).otherwise(F.col("ref"))
    chosen, _ = A.workflows(F.col("workflows"), [workflow], workflow)
    return rows.select(
        F.col("id").alias("job_id"), "kind", shown.alias("ref"), F.when(url, digest).alias("ref_digest"), F.coalesce(F.nullif(F.col("media_type"), F.lit("")), A.media_type(shown)).alias("media_type"), chosen.alias("workflows"), "dedup_threshold", "metadata"
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest(spark.read.schema(S.MANIFEST).json(path))


def media_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def images(spark: SparkSession, path: str) -> DataFrame:
    """S3: decoded images; undecodable files stay, with a height of -1."""
    return spark.read.format("image").option("dropInvalid", False).load(path)


def extraction_logs(spark: SparkSession, path: str) -> DataFrame:
    """Whole log files (path, value)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Stored envelopes."""
    return spark.read.schema(S.ENVELOPE).json(path)


def verdict_of(stored: DataFrame) -> DataFrame:
    """What a consumer looks up by job_id."""
    return stored.select("job_id", F.col("result.overall.verdict").alias("verdict"), F.col("result.overall.top_category").alias("top_category"), F.col("result.overall.max_score").alias("max_score"), "error")


def audit_log(spark: SparkSession, path: str, triage: bool = False) -> DataFrame:
    """Audit records; blank lines are skipped, one bad line fails the read. ``triage`` keeps
    bad lines in ``_corrupt`` instead."""
    if triage:
        return spark.read.schema(S.AUDIT + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return spark.read.schema(S.AUDIT).option("mode", "FAILFAST").json(path)
