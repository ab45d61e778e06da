"""T7 over time: intake judged by the control state of each moment, with a buffer that drains as jobs are taken.

Events of a queue are changes of its control state, jobs taken off its buffer and arrivals. At one time changes
come first, then what is taken, then arrivals by ``seq``. The buffer's length is a walk between two walls, and what any stretch
of events does to it is one function ``x -> min(high, max(low, x + move))``; such functions combine to one of
their kind. So a queue's events are cut into slices of equal size: each gives its function and its last control state, these
few rows are followed through in order, and then each slice judges its own arrivals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

from ..sources.stored import stored

CHANGE, TAKEN, ARRIVAL = 0, 1, 2
FULL = "queue_full"
NO_TIME = "bad_request:no time"


def events(arrivals: DataFrame, changes: DataFrame, taken: DataFrame) -> DataFrame:
    """One table of what happens to queues: ``arrivals`` (queue, at, seq, job_id, bad_request), ``changes`` (queue, at,
    seq, tripped, paused, letters: dead letters added, or removed if negative; NULL leaves a part as it was) and ``taken`` (queue, at, seq)."""
    own = {"bad_request": "string", "job_id": "string", "letters": "long", "paused": "boolean", "tripped": "boolean"}

    def rows(df: DataFrame, kind: int) -> DataFrame:
        given = [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in own.items()]
        return df.select(F.col("queue").cast("string").alias("queue"), F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), F.lit(kind).alias("kind"), *given)

    return rows(arrivals, ARRIVAL).unionByName(rows(changes, CHANGE)).unionByName(rows(taken, TAKEN))


def _reason(tripped: Column, paused: Column, letters: Column, cap: int) -> Column:
    """The first reason that doesn't hang on the buffer."""
    bad = F.col("bad_request")
    return F.when(tripped, "backpressure").when(paused, "paused").when(bad.isNotNull(), F.concat(F.lit("bad_request:"), bad)).when(letters >= cap, "dead_letters_full")


def _numbered(rows: DataFrame, slice_rows: int) -> DataFrame:
    """Events with their slice ``_s`` and place ``_p`` in their queue's order. Only counts by second are summed over a queue."""
    second = F.floor(F.unix_micros("at") / 1_000_000).cast("long")
    rows = rows.withColumn("_u", second)
    before = F.sum("n").over(Window.partitionBy("queue").orderBy("_u")) - F.col("n")
    units = rows.groupBy("queue", "_u").agg(F.count("*").alias("n")).select("queue", "_u", before.alias("_n"))
    place = F.row_number().over(Window.partitionBy("queue", "_u").orderBy("at", "kind", "seq", "job_id")) - 1
    placed = rows.withColumn("_r", place).join(units, ["queue", "_u"]).withColumn("_p", F.col("_n") + F.col("_r"))
    return placed.withColumn("_s", F.floor(F.col("_p") / slice_rows).cast("long")).drop("_u", "_n", "_r")


def _controlled(rows: DataFrame, cap: int) -> DataFrame:
    """Events with ``reason``, by the control state as of each."""
    order = Window.partitionBy("queue", "_s").orderBy("_p")
    marks = ("tripped", "paused")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_p"))).alias(c) for c in marks]
    ends = rows.groupBy("queue", "_s").agg(*last, F.coalesce(F.sum("letters"), F.lit(0)).alias("letters"))
    earlier = Window.partitionBy("queue").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    begun = ends.select("queue", "_s", *[F.last(c, ignorenulls=True).over(earlier).alias(f"_{c}") for c in marks], F.sum("letters").over(earlier).alias("_letters"))
    now = {c: F.coalesce(F.last(c, ignorenulls=True).over(order), F.col(f"_{c}"), F.lit(False)) for c in marks}
    depth = F.coalesce(F.sum("letters").over(order), F.lit(0)) + F.coalesce("_letters", F.lit(0))
    judged = rows.join(begun, ["queue", "_s"]).withColumns({f"{c}_now": v for c, v in now.items()} | {"depth": depth})
    reason = F.when(F.col("kind") == ARRIVAL, _reason(F.col("tripped_now"), F.col("paused_now"), F.col("depth"), cap))
    move = F.when(F.col("kind") == TAKEN, -1).when((F.col("kind") == ARRIVAL) & reason.isNull(), 1).otherwise(0)
    return judged.withColumn("reason", reason).select("queue", "_s", "_p", "kind", "job_id", "reason", move.alias("move"))


def _functions(rows: DataFrame, buffer: int) -> DataFrame:
    """(queue, _s, move, low, high): what each slice does to the length of its buffer."""
    kind = "struct<move:bigint,low:bigint,high:bigint>"
    listed = rows.groupBy("queue", "_s").agg(F.array_sort(F.collect_list(F.when(F.col("move") != 0, F.struct("_p", "move")))).alias("m"))
    walled = lambda x: F.least(F.lit(buffer), F.greatest(F.lit(0), x))
    step = lambda f, e: F.struct((f["move"] + e["move"]).alias("move"), walled(f["low"] + e["move"]).alias("low"), walled(f["high"] + e["move"]).alias("high")).cast(kind)
    none = F.struct(F.lit(0).alias("move"), F.lit(0).alias("low"), F.lit(buffer).alias("high")).cast(kind)
    return listed.select("queue", "_s", F.aggregate("m", none, step).alias("f")).select("queue", "_s", "f.*")


def _follow(batches):
    """The buffer's length where each slice begins; a queue's slices come in order."""
    queue, level = None, 0
    for pdf in batches:
        out = []
        for q, s, move, low, high in zip(pdf["queue"], pdf["_s"], pdf["move"], pdf["low"], pdf["high"], strict=True):
            if q != queue:
                queue, level = q, 0
            out.append((q, s, level))
            level = min(high, max(low, level + move))
        yield pd.DataFrame(out, columns=["queue", "_s", "level"])


def intake(rows: DataFrame, cap: int = 1000, buffer: int = 256, slice_rows: int = 50_000) -> DataFrame:
    """(queue, job_id, accepted, reason, waiting) of every arrival in ``events``: accepted, or the first reason to
    reject it: backpressure, paused, bad_request:..., dead_letters_full, queue_full. ``waiting`` is the buffer's length after it.

    A queue begins open and empty. What is taken off an empty buffer counts for nothing. An arrival without a time is a bad
    request and ``waiting`` is NULL; other events without one are left out. A NULL queue is a queue of its own. Events of
    one kind, time and ``seq`` go by job_id. No task holds more than a slice: windows and the last step stream."""
    wall = int(buffer)
    timed = rows.filter("at is not null").withColumn("queue", F.coalesce(F.concat(F.lit("="), "queue"), F.lit("")))
    judged = stored(_controlled(stored(_numbered(timed, slice_rows), "intake"), cap), "intake-judged")  # both are read twice
    order = ["queue", "_s"]
    levels = _functions(judged, wall).repartition("queue").sortWithinPartitions(*order).mapInPandas(_follow, "queue string, _s long, level long")
    begun = judged.filter(f"kind <> {CHANGE}").join(levels, order)

    def walk(batches):
        at, level = None, 0
        for pdf in batches:
            waiting, reasons = [], []
            for q, s, start, move, why in zip(pdf["queue"], pdf["_s"], pdf["level"], pdf["move"], pdf["reason"], strict=True):
                if (q, s) != at:
                    at, level = (q, s), start
                if move > 0 and level >= wall:
                    why = FULL
                else:
                    level = max(0, level + move)
                waiting.append(level)
                reasons.append(why)
            pdf = pdf.assign(reason=pd.Series(reasons, index=pdf.index, dtype=object), waiting=waiting)
            yield pdf.loc[pdf["kind"] == ARRIVAL, ["queue", "job_id", "reason", "waiting"]]

    kept = begun.repartition(*order).sortWithinPartitions(*order, "_p")
    out = kept.select("queue", "_s", "level", "move", "reason", "kind", "job_id").mapInPandas(walk, "queue string, job_id string, reason string, waiting long")
    named = F.when(F.col("queue") != "", F.substring("queue", F.lit(2), F.length("queue")))
    out = out.select(named.alias("queue"), "job_id", F.col("reason").isNull().alias("accepted"), "reason", "waiting")
    late = rows.filter(f"kind = {ARRIVAL} and at is null").select("queue", "job_id", F.lit(False).alias("accepted"), F.lit(NO_TIME).alias("reason"), F.lit(None).cast("long").alias("waiting"))
    return out.unionByName(late)


class _Queue(StatefulProcessor):
    """T7 by queue: control state and the buffer's length."""

    def __init__(self, cap: int, buffer: int) -> None:
        self.cap, self.buffer = cap, buffer

    def init(self, handle) -> None:
        self.state = handle.getValueState("queue", "tripped boolean, paused boolean, letters long, level long")

    def _why(self, bad: str | None, tripped: bool, paused: bool, letters: int, level: int) -> str | None:
        if tripped or paused:
            return "backpressure" if tripped else "paused"
        if bad is not None:
            return f"bad_request:{bad}"
        return "dead_letters_full" if letters >= self.cap else FULL if level >= self.buffer else None

    def handleInputRows(self, key, rows, timers):  # noqa: N802
        tripped, paused, letters, level = self.state.get() if self.state.exists() else (False, False, 0, 0)
        given = pd.concat(list(rows)).sort_values(["at", "kind", "seq", "job_id"], na_position="last")
        given = given.astype(object).where(given.notna(), None)
        out = []
        for r in given.itertuples():
            if r.at is None:
                if r.kind == ARRIVAL:
                    out.append((key[0], r.job_id, False, NO_TIME, None))
            elif r.kind == CHANGE:
                tripped = tripped if r.tripped is None else bool(r.tripped)
                paused = paused if r.paused is None else bool(r.paused)
                letters += int(r.letters or 0)
            elif r.kind == TAKEN:
                level = max(0, level - 1)
            else:
                why = self._why(r.bad_request, tripped, paused, letters, level)
                level += why is None
                out.append((key[0], r.job_id, why is None, why, level))
        self.state.update((tripped, paused, letters, level))
        yield pd.DataFrame(out, columns=["queue", "job_id", "accepted", "reason", "waiting"]).astype({"waiting": "Int64"})

    def close(self) -> None:
        pass


def live_intake(rows: DataFrame, cap: int = 1000, buffer: int = 256) -> DataFrame:
    """``intake`` over a stream of ``events``; needs the RocksDB state store provider. A queue's events of a micro-batch
    are put in order; one that comes in a later micro-batch counts as later."""
    return rows.groupBy("queue").transformWithStateInPandas(_Queue(cap, buffer), "queue string, job_id string, accepted boolean, reason string, waiting long", "Append", "None")
