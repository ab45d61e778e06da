"""Batch twins of the streaming operators: exact over stored events."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stored import stored


def rates(records: DataFrame, length: str = "1 minute", slide: str | None = None, seconds: int = 60) -> DataFrame:
    """T4: verdicts a second in windows of event time (finished_at)."""
    return records.groupBy(F.window("finished_at", length, slide or length).alias("w"), "verdict").agg((F.count("*") / F.lit(float(seconds))).alias("per_second")).select(F.col("w.start").alias("window_start"), "verdict", "per_second")


def frame_rates(records: DataFrame, length: str = "1 minute", seconds: int = 60) -> DataFrame:
    """T4: frames and errors a second in windows of event time."""
    frames = F.sum(F.coalesce("frames_scanned", F.lit(0))) / F.lit(float(seconds))
    errors = F.count_if(F.col("verdict") == "error") / F.lit(float(seconds))
    return records.groupBy(F.window("finished_at", length).alias("w")).agg(frames.alias("frames_per_second"), errors.alias("errors_per_second")).select(F.col("w.start").alias("window_start"), "frames_per_second", "errors_per_second")


def frames_per_job(records: DataFrame, length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """T4: frames a job by media type in windows that slide: jobs, mean and most. A job without frames counts as 0."""
    n = F.coalesce(F.col("frames_scanned"), F.lit(0))
    return records.groupBy(F.window("finished_at", length, slide).alias("w"), "media_type").agg(F.count("*").alias("jobs"), F.avg(n).alias("mean_frames"), F.max(n).cast("long").alias("most_frames")).select(F.col("w.start").alias("window_start"), "media_type", "jobs", "mean_frames", "most_frames")


def ledger(attempts: DataFrame, max_retries: int = 3, backoff: float = 30.0) -> DataFrame:
    """T5: what follows each attempt (job_id, attempt, disposition, at): done, retry with its time,
    or dead; unknown dispositions are dead, and nothing follows an end."""
    order = Window.partitionBy("job_id").orderBy("attempt")
    retries = F.count_if(F.col("disposition") == "retry").over(order)
    state = F.when(F.col("disposition") == "ack", "done").when((F.col("disposition") == "retry") & (retries <= max_retries), "retry").otherwise("dead")
    rows = attempts.withColumn("retries", retries.cast("long")).withColumn("state", state)
    ended = F.coalesce(F.count_if(F.col("state") != "retry").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ready = F.when(F.col("state") == "retry", F.timestamp_micros(F.unix_micros(F.col("at").cast("timestamp")) + (F.col("retries") * int(backoff * 1_000_000))))
    return rows.withColumn("_e", ended).filter("_e = 0").select("job_id", "attempt", "state", "retries", ready.alias("ready_at"))


def sessions(beats: DataFrame, now: Column, after: int = 60) -> DataFrame:
    """An instance's spans of liveness, closed ``after`` seconds past their last heartbeat, and
    whether they were stale at ``now``."""
    s = beats.groupBy(F.session_window("at", f"{after} seconds").alias("w"), "instance_id").agg(F.count("*").alias("beats"))
    return s.select("instance_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "beats", (F.col("w.end") < now).alias("stale"))


def gate(jobs: DataFrame, control: DataFrame, cap: int = 1000) -> DataFrame:
    """Accepted or the first reason to reject, in order. ``control`` has one row: tripped,
    paused, dead_letters, free; ``jobs`` have bad_request (reason or NULL) and enqueue_seq."""
    c = jobs.join(F.broadcast(control.limit(1)))
    first = F.when(F.col("tripped"), "backpressure").when(F.col("paused"), "paused").when(F.col("bad_request").isNotNull(), F.concat(F.lit("bad_request:"), F.col("bad_request"))).when(F.col("dead_letters") >= cap, "dead_letters_full")
    judged = c.withColumn("_r", first)
    # the buffer fills in arrival order within a source partition
    place = F.count_if(F.col("_r").isNull()).over(Window.partitionBy("source_partition").orderBy("enqueue_seq"))
    reason = F.coalesce("_r", F.when(place > F.col("free"), F.lit("queue_full")))
    return judged.withColumn("reason", reason).select("job_id", F.col("reason").isNull().alias("accepted"), "reason")


class Claim:
    """The claim of one job, by microseconds of event time. A delivery passes unless it is within
    the claim (its end is), and then claims the job anew; a release ends the claim, so that the
    retry of a failed write passes. What has no time neither claims nor is held back."""

    def __init__(self, hold: float, until: int | None = None) -> None:
        self.hold, self.until = int(hold * 1_000_000), until

    def passes(self, at, release=False) -> bool:
        if at != at or at is None:  # NaN stands for null
            return not release
        if release:
            self.until = None
            return False
        if self.until is not None and at <= self.until:
            return False
        self.until = int(at) + self.hold
        return True


def claims(deliveries: DataFrame, at: str = "finished_at", hold: float = 3600.0, releases: DataFrame | None = None) -> DataFrame:
    """The deliveries of each job_id that pass. One that passes claims its job for ``hold``
    seconds; those within the claim are dropped and don't renew it. ``releases`` (job_id, ``at``) undo
    claims: a write that failed lets a later delivery pass. A release of the same time as a delivery comes after it; one
    without a claim, or without a time, does nothing. A job's rows stream through one task in order
    of time, of which only the claim is kept."""
    names = {"_at": F.unix_micros(F.col(at).cast("timestamp")), "_free": F.lit(False)}
    rows = deliveries.withColumns(names)
    if releases is not None:
        freed = releases.select("job_id", at).withColumns(names | {"_free": F.lit(True)})
        rows = rows.unionByName(freed, allowMissingColumns=True)
    placed = rows.repartition("job_id").sortWithinPartitions("job_id", "_at", "_free")
    columns = deliveries.columns

    def passing(batches):
        job, claim = object(), None
        for pdf in batches:
            keep = []
            for j, t, free in zip(pdf.job_id, pdf._at, pdf._free, strict=True):
                if claim is None or j != job:
                    job, claim = j, Claim(hold)
                keep.append(claim.passes(t, free))
            yield pdf.loc[keep, columns]

    return placed.mapInPandas(passing, deliveries.schema)


class Pressure:
    """The back-pressure machine of one adapter. Its window is a queue with a count of the
    wrong outcomes in it, so an outcome costs the same however many the window holds."""

    def __init__(self, n: int = 20, m: int = 5, rate: float = 50.0, window: float = 60.0, samples: int = 10) -> None:
        self.n, self.m, self.rate, self.window, self.samples = n, m, rate, window, samples
        self.bad = self.good = self.wrong = 0
        self.tripped = False
        self.kept: deque[tuple[float, bool]] = deque()

    def saved(self) -> dict:
        return {"bad": self.bad, "good": self.good, "tripped": self.tripped, "kept": list(self.kept)}

    def restore(self, kept: dict) -> None:
        self.bad, self.good, self.tripped = kept["bad"], kept["good"], kept["tripped"]
        self.kept = deque((t, ok) for t, ok in kept["kept"])
        self.wrong = sum(not ok for _, ok in self.kept)

    def record(self, at: float, ok: bool) -> bool:
        """Take an outcome in; returns whether intake is tripped afterwards."""
        while self.kept and self.kept[0][0] <= at - self.window:
            self.wrong -= not self.kept.popleft()[1]
        self.kept.append((at, ok))
        self.wrong += not ok
        if ok:
            self.good, self.bad = self.good + 1, 0
            if self.tripped and self.good >= self.m:
                self.tripped, self.wrong = False, 0
                self.kept.clear()
        else:
            self.bad, self.good = self.bad + 1, 0
            if self.bad >= self.n or len(self.kept) >= self.samples and self.wrong * 100 / len(self.kept) >= self.rate:
                self.tripped = True
        return self.tripped


#: States in which a slice of time may begin: tripped, or open with a window as long as it may be; or
#: open since a recovery whose window is still short, then named by the recovery's time and number.
TRIPPED, OPEN = "tripped", "open"


class _Slice:
    """One adapter's outcomes of a slice of time after those of the window before it.

    Between a recovery and the next trip the machine depends on that recovery alone, and a recovery
    is where the m-th success in a row stands, tripped or not. So what follows a state is looked up
    by counts, without going through the outcomes in between."""

    def __init__(self, pdf: pd.DataFrame, n: int, m: int, rate: float, window: float, samples: int) -> None:
        self.t, self.seq, self.ok = pdf["_t"].to_numpy(), pdf["seq"].to_numpy(), pdf["ok"].to_numpy(bool)
        self.first, self.window = int((~pdf["_own"].to_numpy(bool)).sum()), int(window * 1_000_000)
        self.bad, self.rate, self.samples, self.n = pdf["_bad"].to_numpy(), rate, samples, n
        self.wrong = np.concatenate([[0], np.cumsum(~self.ok)])
        self.low = np.searchsorted(self.t, self.t - self.window, side="right")
        self.recoveries = np.flatnonzero(self.ok & (pdf["_good"].to_numpy() == m))
        self.full = np.flatnonzero(self._trips(0, len(self.t), -1))

    def _trips(self, a: int, b: int, since: int) -> np.ndarray:
        i = np.arange(a, b)
        low = np.maximum(self.low[a:b], since + 1)
        size, wrong = i + 1 - low, self.wrong[i + 1] - self.wrong[low]
        return ~self.ok[a:b] & ((self.bad[a:b] >= self.n) | (size >= self.samples) & (wrong * 100 >= self.rate * np.maximum(size, 1)))

    def _after(self, places: np.ndarray, i: int) -> int:
        k = int(np.searchsorted(places, i))
        return int(places[k]) if k < len(places) else len(self.t)

    def trip(self, since: int) -> int:
        """The first trip in the slice after the recovery at ``since`` (-1: long ago); the length if there is none."""
        a = max(since + 1, self.first)
        b = max(a, int(np.searchsorted(self.low, since, side="right"))) if since >= 0 else a
        short = np.flatnonzero(self._trips(a, b, since))
        return a + int(short[0]) if len(short) else self._after(self.full, b)

    def entries(self) -> list[str]:
        return [TRIPPED, OPEN, *(self.name(int(k)) for k in self.recoveries if k < self.first)]

    def name(self, k: int) -> str:
        return f"{self.t[k]}:{self.seq[k]}"

    def place(self, entry: str) -> int:
        """Where the recovery of an entry stands, -1 if it is long ago."""
        return next((int(k) for k in self.recoveries if k < self.first and self.name(int(k)) == entry), -1)

    def phases(self, entry: str, memo: dict[int, int] | None = None):
        """(place, tripped) where the state changes in the slice."""
        at = self.first - 1 if entry == TRIPPED else None
        since = -1 if entry == TRIPPED else self.place(entry)
        while True:
            if at is None:
                at = memo.get(since) if memo is not None else None
                if at is None:
                    at = self.trip(since)
                    if memo is not None:
                        memo[since] = at
                if at >= len(self.t):
                    return
                yield at, True
            since = self._after(self.recoveries, at + 1)
            if since >= len(self.t):
                return
            yield since, False
            at = None

    def exit(self, entry: str, end: int, memo: dict[int, int]) -> str:
        """The state after the slice, which ends before ``end``."""
        k, tripped = self.place(entry), entry == TRIPPED
        for k, tripped in self.phases(entry, memo):  # noqa: B007
            pass
        return TRIPPED if tripped else self.name(k) if k >= 0 and self.t[k] > end - self.window else OPEN

    def states(self, entry: str) -> np.ndarray:
        out = np.full(len(self.t), entry == TRIPPED)
        for k, tripped in self.phases(entry):
            out[k:] = tripped
        return out[self.first :]


def _counted(outcomes: DataFrame, unit: int, slice_rows: int) -> DataFrame:
    """Outcomes with their unit of time, their slice (units in a row, of about ``slice_rows`` outcomes) and the
    failures and successes in a row up to each, over slices' edges."""
    t = F.unix_micros(F.col("at").cast("timestamp"))
    named = F.coalesce(F.concat(F.lit("="), "adapter"), F.lit("")).alias("adapter")  # no adapter is one of its own
    rows = outcomes.select(named, "at", "seq", F.coalesce("ok", F.lit(False)).alias("ok"), t.alias("_t"), F.floor(t / unit).cast("long").alias("_u"))
    # a row a unit: how many outcomes come before it
    done = F.sum("n").over(Window.partitionBy("adapter").orderBy("_u")) - F.col("n")
    units = rows.groupBy("adapter", "_u").agg(F.count("*").alias("n")).select("adapter", "_u", F.floor(done / slice_rows).cast("long").alias("_s"))
    rows = rows.join(units, ["adapter", "_u"])
    order = Window.partitionBy("adapter", "_s").orderBy("at", "seq")
    placed = rows.withColumn("_p", F.row_number().over(order))
    last = {"_bad": F.max(F.when(F.col("ok"), F.col("_p"))).over(order), "_good": F.max(F.when(~F.col("ok"), F.col("_p"))).over(order)}
    placed = stored(placed.withColumns(last), "outcomes")  # read several times
    ends = placed.groupBy("adapter", "_s").agg(F.count("*").alias("n"), *[(F.count("*") - F.coalesce(F.max(F.when(hit, F.col("_p"))), F.lit(0))).alias(c) for c, hit in (("bad", F.col("ok")), ("good", ~F.col("ok")))])
    # a row a slice: slices of one kind alone carry on what came before them
    over = Window.partitionBy("adapter").orderBy("_s")
    for c in ("bad", "good"):
        ends = ends.withColumn("_g", F.count_if(F.col(c) < F.col("n")).over(over))
        ends = ends.withColumn(f"{c}_out", F.sum(c).over(Window.partitionBy("adapter", "_g").orderBy("_s")))
        ends = ends.withColumn(f"{c}_in", F.coalesce(F.lag(f"{c}_out").over(over), F.lit(0)))
    joined = placed.join(stored(ends.select("adapter", "_s", "bad_in", "good_in"), "slices"), ["adapter", "_s"])
    count = lambda c, own: F.when(own, F.lit(0)).otherwise(F.col("_p") - F.coalesce(F.col(f"_{c}"), -F.col(f"{c}_in")))
    return joined.select("adapter", "at", "seq", "ok", "_t", "_u", "_s", count("bad", F.col("ok")).alias("_bad"), count("good", ~F.col("ok")).alias("_good"))


def backpressure(outcomes: DataFrame, n: int = 20, m: int = 5, rate: float = 50.0, window: float = 60.0, samples: int = 10, slice_rows: int = 50_000) -> DataFrame:
    """The tripped state after each outcome (adapter, at, seq, ok), whose order within an adapter matters.

    Adapters are few and their outcomes many, so an adapter's time is cut into slices. A slice sees the
    window before it and says, for every state it may begin in, in which it ends; those
    tables, a few rows a slice, are followed through in order; then each slice gives its outcomes'
    states. A slice is a number of windows' lengths with about ``slice_rows`` outcomes, which are held together. An outcome
    without a time has no state (NULL) and changes none; one without ``ok`` failed. ``seq`` is unique among equal times."""
    unit = int(window * 1_000_000)
    schema = "adapter string, at timestamp, seq long, tripped boolean"
    rows = _counted(outcomes.filter("at is not null"), unit, slice_rows)
    # the window before a slice lies in the unit before its first
    edge = rows.groupBy("adapter", "_s").agg(F.min("_u").alias("_u")).select("adapter", F.col("_s").alias("_next"), (F.col("_u") - 1).alias("_u"))
    before = rows.join(edge, ["adapter", "_u"]).filter("_next <> _s").withColumn("_s", F.col("_next")).drop("_next").withColumn("_own", F.lit(False))
    slices = rows.withColumn("_own", F.lit(True)).unionByName(before)

    def read(pdf: pd.DataFrame) -> _Slice:
        return _Slice(pdf.sort_values(["_own", "_t", "seq"], kind="stable"), n, m, rate, window, samples)

    def table(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, memo = read(pdf), {}
        end = (int(pdf["_u"].max()) + 1) * unit
        rows = [(key[0], key[1], e, own.exit(e, end, memo)) for e in own.entries()]
        return pd.DataFrame(rows, columns=["adapter", "_s", "entry", "exit"]).astype({"_s": "int64"})

    def follow(batches):
        adapter, at, state, found = None, None, OPEN, {}
        for pdf in _then_none(batches):
            out = []
            for a, s, entry, exit_ in zip(pdf.adapter, pdf["_s"], pdf.entry, pdf.exit, strict=True) if pdf is not None else [(None, None, None, None)]:
                if (a, s) != (adapter, at):
                    if at is not None:
                        begun = state if state in found else OPEN  # a short window is long over by then
                        out.append((adapter, at, begun))
                        state = found[begun] if a == adapter else OPEN
                    adapter, at, found = a, s, {}
                found[entry] = exit_
            if out:
                yield pd.DataFrame(out, columns=["adapter", "_s", "entry"])

    def states(key: tuple, pdf: pd.DataFrame, begun: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["_own"]].sort_values(["_t", "seq"], kind="stable")
        tripped = read(pdf).states(begun.entry.iloc[0]) if len(own) else np.empty(0, bool)
        return own[["adapter", "at", "seq"]].assign(tripped=tripped)

    keys = ["adapter", "_s"]
    tables = slices.groupBy(*keys).applyInPandas(table, "adapter string, _s long, entry string, exit string")
    entries = tables.repartition("adapter").sortWithinPartitions(*keys).mapInPandas(follow, "adapter string, _s long, entry string")
    timed = slices.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(states, schema)
    timed = timed.withColumn("adapter", F.when(F.col("adapter") != "", F.substring("adapter", F.lit(2), F.length("adapter"))))
    return timed.unionByName(outcomes.filter("at is null").select("adapter", "at", "seq", F.lit(None).cast("boolean").alias("tripped")))


def _then_none(batches):
    yield from batches
    yield None
