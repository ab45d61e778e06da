"""Structured Streaming: continuous moderation, redelivery, back-pressure, retries, liveness, audit."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from ..operators import audit
from ..operators.verdict import disposition
from ..schemas import AUDIT, HEADS_OF_CHAINS as HEADS
from ..sources import commits, sinks
from .batch import Claim, Pressure

log = logging.getLogger(__name__)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Claims(StatefulProcessor):
    """T2 by job: the claim's end, cleared by a timer once no delivery that may still come is within it."""

    def __init__(self, columns: list[str], hold: float) -> None:
        self.columns, self.hold = columns, hold

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("claim", "until long")

    def handleInputRows(self, key, rows, timers):  # noqa: N802
        pdf = pd.concat(list(rows))
        pdf = pdf.sort_values(["claim_at_", "release_"], kind="stable")
        claim = Claim(self.hold, self.state.get()[0] if self.state.exists() else None)
        before = claim.until
        keep = [claim.passes(t, free) for t, free in zip(pdf.claim_at_, pdf.release_, strict=True)]
        if claim.until is None:
            self.state.clear()
        elif claim.until != before:
            self.state.update((claim.until,))
            self.handle.registerTimer(claim.until // 1000 + 1)
        yield pdf.loc[keep, self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        # an earlier claim's timer finds a later claim here
        if self.state.exists() and self.state.get()[0] < expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def claims(deliveries: DataFrame, at: str = "submitted_at", hold: float = 3600.0, late: str = "10 minutes", releases: DataFrame | None = None) -> DataFrame:
    """``batch.claims`` over a stream; needs the RocksDB state store provider.

    A delivery is compared with the end of its job's claim, not with how long state is held, so one
    after the claim passes however quiet the stream was. Rows later than ``late`` are dropped, and one
    that comes after a later delivery of its job is within that one's claim. ``releases`` is a stream
    of (job_id, ``at``). A job's rows of one micro-batch are held together to be put in order."""
    names = {"claim_at_": F.unix_micros(F.col(at).cast("timestamp")), "release_": F.lit(False)}
    rows = deliveries.withColumns(names)
    if releases is not None:
        rows = rows.unionByName(releases.select("job_id", at).withColumns(names | {"release_": F.lit(True)}), allowMissingColumns=True)
    placed = rows.withWatermark(at, late).groupBy("job_id")
    return placed.transformWithStateInPandas(_Claims(deliveries.columns, hold), deliveries.schema, "Append", "EventTime")


def once_an_hour(jobs: DataFrame) -> DataFrame:
    """Redeliveries within an hour, of event time, of a delivery that passed are dropped; later ones pass."""
    return claims(jobs)


def rates(records: DataFrame, late: str = "10 minutes") -> DataFrame:
    """T4: verdicts a second by minute; rows later than ``late`` are dropped."""
    return records.withWatermark("finished_at", late).groupBy(F.window("finished_at", "1 minute").alias("w"), "verdict").agg((F.count("*") / 60.0).alias("per_second")).select(F.col("w.start").alias("window_start"), "verdict", "per_second")


def liveness(beats: DataFrame, after: int = 60) -> DataFrame:
    """A closed session of heartbeats tells that its instance is stale."""
    return beats.withWatermark("at", f"{after} seconds").groupBy(F.session_window("at", f"{after} seconds").alias("w"), "instance_id").agg(F.count("*").alias("beats")).select("instance_id", F.col("w.end").alias("stale_at"), "beats")


class _Silence(StatefulProcessor):
    """T6 by instance: its last heartbeat, and a timer of processing time that the next one puts off."""

    def __init__(self, after: float) -> None:
        self.after = after

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("beat", "last long, beats long")

    def handleInputRows(self, key, rows, timers):  # noqa: N802
        last, beats = self.state.get() if self.state.exists() else (None, 0)
        for pdf in rows:
            known = pdf["micros_"].dropna()
            beats += len(pdf)
            if len(known):
                last = int(known.max()) if last is None else max(last, int(known.max()))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(self.after * 1000))
        self.state.update((last, int(beats)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        if self.state.exists():
            last, beats = self.state.get()
            self.state.clear()
            at = pd.NaT if last is None else pd.Timestamp(last + int(self.after * 1_000_000), unit="us")
            yield pd.DataFrame({"instance_id": [key[0]], "stale_at": pd.Series([at], dtype="datetime64[us]"), "beats": [beats]})

    def close(self) -> None:
        pass


def silent(beats: DataFrame, after: float = 60.0) -> DataFrame:
    """(instance_id, stale_at, beats) of every instance from which nothing has come for ``after`` seconds
    of processing time, once for each silence; needs the RocksDB state store provider. Unlike
    ``liveness`` it waits for no other heartbeat: if all instances die, all are told. ``stale_at`` is
    ``after`` seconds past the last heartbeat (NULL if none had a time). Run it with a trigger of a few seconds."""
    rows = beats.select("instance_id", F.unix_micros(F.col("at").cast("timestamp")).alias("micros_"))
    return rows.groupBy("instance_id").transformWithStateInPandas(_Silence(after), "instance_id string, stale_at timestamp, beats long", "Append", "ProcessingTime")


def reclaim(beats: DataFrame, claims: Callable[[], DataFrame], take: Callable[[DataFrame], None], after: float = 60.0) -> DataStreamWriter:
    """The claims (job_id, instance_id) of silent instances go to ``take`` as soon as their silence is told."""

    def batch(df: DataFrame, _: int) -> None:
        take(claims().join(df.select("instance_id").distinct(), "instance_id", "left_semi"))

    return silent(beats, after).writeStream.foreachBatch(batch)


class _PressureState(StatefulProcessor):
    """T3 by adapter; the machine's numbers and window live in the state store."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("machine", "text string")

    def handleInputRows(self, key, rows, timers):  # noqa: N802
        machine = Pressure()
        if self.state.exists():
            kept = json.loads(self.state.get()[0])
            machine.restore(kept)
        out = []
        for pdf in rows:
            for r in pdf.sort_values(["at", "seq"]).itertuples():
                out.append((key[0], r.at, r.seq, machine.record(r.at.timestamp(), bool(r.ok))))
        self.state.update((json.dumps(machine.saved()),))
        yield pd.DataFrame(out, columns=["adapter", "at", "seq", "tripped"])

    def close(self) -> None:
        pass


def backpressure(outcomes: DataFrame) -> DataFrame:
    """Needs the RocksDB state store provider."""
    return outcomes.groupBy("adapter").transformWithStateInPandas(_PressureState(), "adapter string, at timestamp, seq long, tripped boolean", "Append", "None")


class _Ledger(StatefulProcessor):
    """T5 by job: retries so far and whether the job has ended."""

    def __init__(self, max_retries: int, backoff: float) -> None:
        self.max_retries, self.backoff = max_retries, backoff

    def init(self, handle) -> None:
        self.state = handle.getValueState("job", "retries long, ended boolean")

    def handleInputRows(self, key, rows, timers):  # noqa: N802
        retries, ended = self.state.get() if self.state.exists() else (0, False)
        out = []
        for pdf in rows:
            for r in pdf.sort_values("attempt").itertuples():
                if ended:
                    continue
                retries += r.disposition == "retry"
                state = "done" if r.disposition == "ack" else "retry" if r.disposition == "retry" and retries <= self.max_retries else "dead"
                ended = state != "retry"
                out.append((key[0], r.attempt, state, retries, None if ended else r.at + pd.Timedelta(seconds=self.backoff * retries)))
        self.state.update((int(retries), bool(ended)))
        yield pd.DataFrame(out, columns=["job_id", "attempt", "state", "retries", "ready_at"])

    def close(self) -> None:
        pass


def ledger(attempts: DataFrame, max_retries: int = 3, backoff: float = 30.0) -> DataFrame:
    """T5: needs the RocksDB state store provider."""
    return attempts.groupBy("job_id").transformWithStateInPandas(_Ledger(max_retries, backoff), "job_id string, attempt long, state string, retries long, ready_at timestamp", "Append", "None")


def moderate(jobs: DataFrame, process: Callable[[DataFrame], DataFrame], store: str, letters: str, extra: list | None = None, record: Callable[[DataFrame], None] | None = None, outcomes: str | None = None) -> DataStreamWriter:
    """A job stream to envelopes (``process`` gives job_id, verdict, error, attempts, at and what
    the store keeps), in this order: all sinks are tried, then ``record`` (the audit), then the
    disposition is known: retry if a sink failed (nothing is audited), dead_letter if the audit
    failed or the verdict is error, else ack. Dead letters go to ``letters`` and dispositions to
    ``outcomes``, both once for each (job_id, attempts), so a replayed batch writes none twice; nor does
    ``audit_batch`` as ``record``, which knows the batch by its query and number. A dead letter of a
    refused audit tells why. Without
    ``outcomes`` a sink's failure is raised, and Spark replays the batch."""

    def batch(df: DataFrame, _: int) -> None:
        done = process(df).drop("disposition").persist()
        try:
            failures, first = sinks.attempt_all(done, [("store", lambda d: sinks.append_once(d.drop("attempts", "at"), store)), *(extra or [])])
            if failures and outcomes is None:
                raise first
            refused = None
            if record is not None and not failures:
                try:
                    record(done)
                except Exception as e:
                    refused = f"audit: {str(e)[:500] or type(e).__name__}"
                    log.warning("the audit refused a batch", exc_info=True)
            final = done.withColumn("disposition", disposition(F.lit(not failures), F.lit(refused is None), F.col("verdict")))
            if refused is not None:
                final = final.withColumn("error", F.concat_ws("; ", F.lit(refused), "error"))
            sinks.append_once(sinks.dead_letters(final), letters, ("job_id", "attempts"), "at")
            if outcomes is not None:
                sinks.append_once(final.select("job_id", F.col("attempts").cast("long").alias("attempts"), "disposition", "at"), outcomes, ("job_id", "attempts"), "at")
        finally:
            done.unpersist()

    return jobs.writeStream.foreachBatch(batch)


#: Commits of heads after which one stands for all before it.
SNAPSHOT = 32


def current_batch(spark: SparkSession) -> tuple[str, int] | None:
    """(query id, batch id) of the micro-batch that calls, None outside a stream."""
    query, batch = (spark.sparkContext.getLocalProperty(k) for k in ("sql.streaming.queryId", "streaming.sql.batchId"))
    return (query, int(batch)) if query and batch else None


def audit_tail(spark: SparkSession, log: str, heads: str, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, ends): of each of ``chains``, and of those whose heads aren't stored yet, the last verified
    record (chain_id, seq, entry_hash, log_version) and the records from it on. Only the log's commits that
    have such a record, and those after the last whose heads are stored, are read."""
    through = commits.state(spark, heads).ledger.get("log", -1)
    version = commits.state(spark, log).version
    recent = [-1, *range(through + 1, version + 1)] if through < 0 else range(through + 1, version + 1)
    later = commits.read(spark, log, AUDIT, recent)
    wanted = chains.select("chain_id").unionByName(later.select("chain_id")).distinct()
    ends = commits.read(spark, heads, HEADS).join(wanted, "chain_id", "left_semi").groupBy("chain_id").agg(F.max("seq").alias("seq"), F.max_by("entry_hash", "seq").alias("entry_hash"), F.max_by("log_version", "seq").alias("log_version"))
    # one number for each commit that holds an end, not for each chain
    held = {r.log_version for r in ends.select("log_version").distinct().collect() if r.log_version is not None}
    known = commits.read(spark, log, AUDIT, held | set(recent)).join(wanted, "chain_id", "left_semi").join(ends.select("chain_id", F.col("seq").alias("_end")), "chain_id", "left")
    return known.filter("_end is null or seq >= _end").drop("_end"), ends


def audit_batch(df: DataFrame, log: str, heads: str, batch: tuple[str, int] | None = None) -> None:
    """Appends decisions and events to the stored chains, continuing from their ends, and
    then their new heads to ``heads``.

    What has been verified is not read again: stored heads are the ends of verified records, and only
    what came after them is checked (``audit.verify`` checks whole chains). A chain whose tail does not verify, or that
    lacks the record its head names, refuses the batch: appending would hide what is missing.
    Records land before a head names them, so after a stop in between the next batch verifies them and
    names them first. ``batch`` is (query, batch id), by default that of the stream that calls: a
    batch that the log's ledger has is left out, so a replay adds nothing."""
    spark = df.sparkSession
    batch = batch or current_batch(spark)

    def new(_: commits.State) -> DataFrame:
        tail, ends = audit_tail(spark, log, heads, df)
        broken = audit.verify(tail, ends).filter("first_broken is not null").limit(1).collect()
        lost = audit.anchors(tail, ends).filter("status in ('truncated', 'rewritten')").limit(1).collect()
        if lost:
            raise ValueError(f"audit chain {lost[0].chain_id} is {lost[0].status}")
        if broken:
            raise ValueError(f"audit chain {broken[0].chain_id} is broken at {broken[0].first_broken}")
        return audit.append(audit.unseen(commits.read(spark, log, AUDIT).join(df.select("chain_id").distinct(), "chain_id", "left_semi"), df), audit.heads_of(tail))

    commits.append(spark, log, new, batch)
    _store_heads(spark, log, heads)


def _store_heads(spark: SparkSession, log: str, heads: str) -> None:
    """Heads of the log's commits that have none yet; their records were verified or written by ``audit_batch``."""
    version = commits.state(spark, log).version
    due = lambda now: now.version - now.base >= SNAPSHOT

    def new(now: commits.State) -> DataFrame:
        added = commits.read(spark, log, AUDIT, range(now.ledger.get("log", -1) + 1, version + 1)).withColumn("log_version", F.try_to_number(F.regexp_extract("_metadata.file_name", r"^c(\d{10})-", 1), F.lit("9999999999")).cast("long"))
        rows = added.select("chain_id", "seq", "entry_hash", "log_version")
        rows = rows.unionByName(commits.read(spark, heads, HEADS)) if due(now) else rows
        return rows.groupBy("chain_id").agg(F.max("seq").alias("seq"), F.max_by("entry_hash", "seq").alias("entry_hash"), F.max_by("log_version", "seq").alias("log_version"))

    commits.append(spark, heads, new, ("log", version), snapshot=due)


def audit_append(rows: DataFrame, log: str, heads: str) -> DataStreamWriter:
    """``audit_batch`` for every micro-batch of a stream."""
    return rows.writeStream.foreachBatch(lambda df, _: audit_batch(df, log, heads))
