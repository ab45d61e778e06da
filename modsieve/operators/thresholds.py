"""Threshold tables and their resolution: label, then category, then default, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.local import local
from ..functions.normalize import canonical

SCHEMA = "key string, flag_at double, block_at double"


def defaults(spark: SparkSession) -> DataFrame:
    """The built-in table; a handful of rows."""
    return local(spark, S.DEFAULT_THRESHOLDS, SCHEMA)


def merge(base: DataFrame, labels: DataFrame, mode: str, unarmed: DataFrame | None = None) -> DataFrame:
    """off = the base table, hybrid = base and labels, override = labels alone. Unarmed labels
    become rows without bounds. ``labels`` and ``unarmed`` hold bare label names in ``key``."""
    if mode in ("", "off"):
        return base
    own = labels.select(F.concat(F.lit("label:"), F.lower("key")).alias("key"), "flag_at", "block_at")
    if unarmed is not None:
        own = own.unionByName(unarmed.select(F.concat(F.lit("label:"), F.lower("key")).alias("key"), F.lit(None).cast("double").alias("flag_at"), F.lit(None).cast("double").alias("block_at")))
    if mode == "override":
        return own
    if mode == "hybrid":
        return base.unionByName(own)
    raise ValueError(f"unknown mode {mode!r}: off, hybrid, override")


def resolve(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``flag_at`` and ``block_at`` of every category row, by three left equi-joins.

    The table has one row for a key. Spark broadcasts it when its size allows; make small tables with
    ``local``, whose size it knows before it plans: then no category row is shuffled."""
    by = lambda name: thresholds.select(F.col("key").alias(f"_{name}"), F.col("flag_at").alias(f"_{name}_flag"), F.col("block_at").alias(f"_{name}_block"))
    out = rows.join(by("label"), F.concat(F.lit("label:"), F.lower("provider_label")) == F.col("_label"), "left")
    out = out.join(by("category"), canonical(F.col("category")) == F.col("_category"), "left")
    out = out.join(F.broadcast(_default(thresholds)))  # one row
    flag = F.coalesce("_label_flag", "_category_flag", "_default_flag")
    block = F.coalesce("_label_block", "_category_block", "_default_block")
    return out.select(*rows.columns, flag.alias("flag_at"), block.alias("block_at"))


def _default(thresholds: DataFrame) -> DataFrame:
    """The default bounds as one row, NULL where the table has none."""
    own = F.col("key") == "default"
    return thresholds.agg(F.max(F.when(own, F.col("flag_at"))).alias("_default_flag"), F.max(F.when(own, F.col("block_at"))).alias("_default_block"))


def apply(rows: DataFrame) -> DataFrame:
    """``flagged`` and the stamped ``threshold``; NaN never flags."""
    score = F.when(~F.isnan("score"), F.col("score"))
    return rows.withColumn("threshold", F.col("flag_at")).withColumn("flagged", F.coalesce(score >= F.col("flag_at"), F.lit(False)))


def uncovered(labels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Labels (label) that no threshold key names, by presence of the key alone."""
    keys = thresholds.select(F.col("key").alias("_key"))
    return labels.join(keys, F.concat(F.lit("label:"), F.lower("label")) == F.col("_key"), "left_anti")


def violations(tables: DataFrame) -> DataFrame:
    """P25: rows (config_id, mode, kind, key, flag_at, block_at) against the rules for tables;
    kind is base, label or unarmed. Returns (config_id, rule, key)."""
    mode = F.lower(F.trim(F.coalesce("mode", F.lit(""))))
    rows = tables.withColumn("mode", mode).withColumn("label", F.lower("key"))
    out_of = lambda c: F.coalesce((c < 0) | (c > 1), F.lit(False))
    bounds = rows.filter(out_of(F.col("flag_at")) | out_of(F.col("block_at"))).select("config_id", F.lit("bound outside 0 to 1").alias("rule"), "key")
    per = rows.groupBy("config_id", "mode").agg(F.count_if(F.col("kind") == "label").alias("labels"), F.count_if(F.col("kind") != "base").alias("own"))
    unknown = per.filter(~F.col("mode").isin("", "off", "hybrid", "override")).select("config_id", F.lit("unknown mode").alias("rule"), F.col("mode").alias("key"))
    unused = per.filter(F.col("mode").isin("", "off") & (F.col("own") > 0)).select("config_id", F.lit("labels while off").alias("rule"), F.col("mode").alias("key"))
    empty = per.filter((F.col("mode") == "override") & (F.col("labels") == 0)).select("config_id", F.lit("override without labels").alias("rule"), F.col("mode").alias("key"))
    both = rows.filter("kind <> 'base'").groupBy("config_id", "label").agg(F.count_if(F.col("kind") == "label").alias("a"), F.count_if(F.col("kind") == "unarmed").alias("b")).filter("a > 0 and b > 0").select("config_id", F.lit("armed and unarmed").alias("rule"), F.col("label").alias("key"))
    return bounds.unionByName(unknown).unionByName(unused).unionByName(empty).unionByName(both)


def number_text(c: Column) -> Column:
    """A double as the shortest JSON number without a trailing .0."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"\.0$", ""), F.lit("null"))


def config_hash(tables: DataFrame) -> DataFrame:
    """(adapter, model_version, config_hash) of rows (adapter, model_version, key, flag_at,
    block_at): SHA-256 of canonical JSON with keys in order."""
    quoted = lambda s: F.concat(F.lit('"'), s, F.lit('"'))
    one = F.concat(quoted(F.col("key")), F.lit(':{"flag_at":'), number_text(F.col("flag_at")), F.lit(',"block_at":'), number_text(F.col("block_at")), F.lit("}"))
    all_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", one.alias("text")))), lambda x: x["text"]), ",")
    grouped = tables.groupBy("adapter", "model_version").agg(all_.alias("_t"))
    text = F.concat(F.lit('{"adapter":'), quoted(F.col("adapter")), F.lit(',"model_version":'), quoted(F.col("model_version")), F.lit(',"thresholds":{'), F.col("_t"), F.lit("}}"))
    return grouped.select("adapter", "model_version", F.sha2(text, 256).alias("config_hash"))
