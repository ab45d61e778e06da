"""Sinks: envelopes as JSON lines, idempotent writes, fan-out, receivers, dead letters."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import commits

FULL = {"ignoreNullFields": "false"}


def _member(name: str, text: Column) -> Column:
    """An optional JSON member: absent where ``text`` is NULL."""
    return F.coalesce(F.concat(F.lit(f',"{name}":'), text), F.lit(""))


def _string(c: Column) -> Column:
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


def _frame(f: Column) -> Column:
    head = F.regexp_extract(F.to_json(F.struct(f["timestamp_sec"].alias("timestamp_sec"), f["status"].alias("status")), FULL), r"(?s)^(.*)\}$", 1)
    return F.concat(head, _member("error", _string(f["error"])), F.lit(',"categories":['), F.array_join(F.transform(f["categories"], lambda c: F.to_json(c, FULL)), ","), F.lit("]}"))


def envelope_json(envelopes: DataFrame) -> DataFrame:
    """K1: (job_id, value): one object a job. Scores, thresholds, times and verdict fields are
    present as null; error, metadata, result and digest are absent where there is none."""
    r, s = F.col("result"), F.col("source")
    source = F.concat(F.regexp_extract(F.to_json(F.struct(s["kind"].alias("kind"), s["ref"].alias("ref")), FULL), r"(?s)^(.*)\}$", 1), _member("ref_digest", _string(s["ref_digest"])), F.lit(',"media_type":'), F.coalesce(_string(s["media_type"]), F.lit("null")), F.lit("}"))
    facts = F.regexp_extract(F.to_json(F.struct(*[r[k].alias(k) for k in ("schema_version", "provider", "model_version", "media_type", "asset_id")]), FULL), r"(?s)^(.*)\}$", 1)
    result = F.concat(facts, F.lit(',"frames":['), F.array_join(F.transform(r["frames"], _frame), ","), F.lit('],"overall":'), F.to_json(r["overall"], FULL), F.lit("}"))
    times = F.regexp_extract(F.to_json(F.struct("started_at", "finished_at"), {**FULL, "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"}), r"(?s)^\{(.*)\}$", 1)
    text = F.concat(
        F.lit('{"job_id":'), _string(F.col("job_id")), F.lit(',"source":'), source, F.lit(',"model_id":'), F.to_json(F.col("model_id"), FULL),
        _member("result", F.when(r.isNotNull(), result)), _member("error", _string(F.col("error"))), _member("metadata", F.col("metadata")), F.lit(","), times, F.lit("}"),
    )
    return envelopes.select("job_id", text.alias("value"))


def write_envelopes(envelopes: DataFrame, path: str) -> None:
    envelope_json(envelopes).select("value").write.mode("append").text(path)


def fresh(batch: DataFrame, stored: DataFrame, order: str = "finished_at", keys: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """Rows of ``batch`` whose keys are not stored, the first of each in the batch."""
    new = batch.join(stored.select(*keys).distinct(), list(keys), "left_anti")
    return new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def append_once(batch: DataFrame, path: str, keys: tuple[str, ...] = ("job_id",), at: str = "finished_at", days: int = 2) -> None:
    """K2: a durable idempotent append to a Parquet table, as one commit (``commits``): a writer that
    stops midway leaves nothing or all, and of two at a time the second sees the first's rows.
    Where ``at`` is a time, the table has a folder for each ``day``, and only those from ``days``
    before the batch's first are looked through: what is older than the retention is not read, and a
    redelivery of it is written. Rows without a time have no age: a batch that has some is compared with every day."""
    timed = batch.schema[at].dataType.typeName() in ("timestamp", "timestamp_ntz")
    rows = batch.withColumn("day", F.to_date(at)) if timed else batch
    since = rows.agg(F.date_sub(F.min("day"), days).alias("d"), F.count_if(F.col("day").isNull()).alias("n")).first() if timed else None

    def new(_: commits.State) -> DataFrame:
        stored = commits.committed(batch.sparkSession, path)
        if stored is None:
            stored = rows.limit(0)
        elif timed and not since.n and since.d is not None:
            stored = stored.filter(F.col("day").isNull() | (F.col("day") >= F.lit(since.d)))
        return fresh(rows, stored, at, keys)

    commits.append(batch.sparkSession, path, new, by="day" if timed else None)


def attempt_all(batch: DataFrame, sinks: Iterable[tuple[str, Callable[[DataFrame], None]]]) -> tuple[dict[str, int], Exception | None]:
    """K3: tries every sink; (failures by sink, the first failure)."""
    failures: dict[str, int] = {}
    first: Exception | None = None
    for name, write in sinks:
        try:
            write(batch)
        except Exception as e:
            failures[name] = failures.get(name, 0) + 1
            first = first or e
    if first is not None:
        first.add_note(f"failures by sink: {failures}")
    return failures, first


def fan_out(batch: DataFrame, sinks: Iterable[tuple[str, Callable[[DataFrame], None]]]) -> dict[str, int]:
    """K3: every sink is tried; the first failure is raised afterwards. Returns failures by sink."""
    batch = batch.persist()
    try:
        failures, first = attempt_all(batch, sinks)
    finally:
        batch.unpersist()
    if first is not None:
        raise first
    return failures


def push(envelopes: DataFrame, post: Callable[[list[str]], None], size: int = 100) -> None:
    """K4: envelopes to a receiver in batches; ``post`` does the call, with its own retries."""

    def send(rows) -> None:
        batch: list[str] = []
        for r in rows:
            batch.append(r.value)
            if len(batch) == size:
                post(batch)
                batch = []
        if batch:
            post(batch)

    envelope_json(envelopes).select("value").foreachPartition(send)


def dead_letters(jobs: DataFrame) -> DataFrame:
    """K5: (job_id, reason, attempts, at) of jobs whose disposition is dead_letter."""
    return jobs.filter("disposition = 'dead_letter'").select("job_id", F.coalesce("error", F.lit("could not evaluate")).alias("reason"), F.col("attempts").cast("long").alias("attempts"), "at")
