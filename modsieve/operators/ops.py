"""Operations: verdict and frame statistics, histograms, queues, liveness, outages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def verdict_stats(records: DataFrame) -> DataFrame:
    """A3: counts for each verdict and the rates over evaluated or finished jobs."""
    n = {v: F.count_if(F.col("verdict") == v).alias(v) for v in ("allow", "flag", "block", "error", "skip")}
    c = records.agg(*n.values(), F.count("*").alias("total")).withColumn("evaluated", F.col("allow") + F.col("flag") + F.col("block"))
    return c.select("*", ratio(F.col("flag") + F.col("block"), F.col("evaluated")).alias("flag_rate"), ratio(F.col("block"), F.col("evaluated")).alias("block_rate"), ratio(F.col("error"), F.col("total")).alias("error_rate"))


def frame_stats(records: DataFrame) -> DataFrame:
    """A4: frames in all, frames and jobs of videos, flagged frames of flagged videos."""
    video = F.col("media_type") == "video"
    hit = video & F.col("verdict").isin("flag", "block")
    c = records.agg(
        F.sum("frames_scanned").alias("total_frames"), F.count_if(video).alias("video_jobs"), F.sum(F.when(video, F.col("frames_scanned")).otherwise(0)).alias("video_frames"),
        F.count_if(hit).alias("flagged_videos"), F.sum(F.when(hit, F.col("frames_flagged")).otherwise(0)).alias("_f"), F.count_if(hit & (F.col("frames_flagged") == 1)).alias("single_frame_videos"),
    )
    return c.select("total_frames", "video_jobs", "video_frames", ratio(F.col("video_frames"), F.col("video_jobs")).alias("avg_frames"), "flagged_videos", ratio(F.col("_f"), F.col("flagged_videos")).alias("avg_flagged_frames"), "single_frame_videos")


def counters(records: DataFrame) -> DataFrame:
    """A5: (metric, label, value) in long form: one pass and one exchange for all counters. Records
    have verdict, media_type, frames_scanned and adapter, and may have error_code, fetch_reason,
    fetch_bytes and sink_failure (a sink's type), NULL where there was none."""
    one = F.lit(1).cast("long")

    def counter(metric: str, label: Column, n: Column = one) -> Column:
        return F.struct(F.lit(metric).alias("metric"), label.alias("label"), n.alias("n"))

    own = [counter("jobs", F.col("verdict")), counter("frames", F.col("media_type"), F.col("frames_scanned").cast("long")), counter("errors", F.col("adapter"), F.when(F.col("verdict") == "error", 1).otherwise(0).cast("long"))]
    more = {
        "error_code": lambda c: F.when(c.isNotNull(), counter("adapter_errors", F.concat_ws(":", F.col("adapter"), c))),
        "fetch_reason": lambda c: F.when(c.isNotNull(), counter("fetch_failures", c)),
        "fetch_bytes": lambda c: F.when(c.isNotNull(), counter("fetch_bytes", F.lit("all"), c.cast("long"))),
        "sink_failure": lambda c: F.when(c.isNotNull(), counter("sink_failures", c)),
    }
    own += [make(F.col(c)) for c, make in more.items() if c in records.columns]
    return records.select(F.inline(F.filter(F.array(*own), lambda x: x.isNotNull()))).groupBy("metric", "label").agg(F.sum("n").alias("value"))


def histogram(rows: DataFrame, value: str, edges: list[float], by: str) -> DataFrame:
    """Cumulative counts (by, le, n) for fixed edges and +Inf: one aggregation, one column an edge."""
    counts = rows.groupBy(by).agg(*[F.count_if(F.col(value) <= e).alias(f"_{i}") for i, e in enumerate(edges)], F.count(value).alias("_inf"))
    bars = F.array(*[F.struct(F.lit(str(float(e))).alias("le"), F.col(f"_{i}").alias("n")) for i, e in enumerate(edges)], F.struct(F.lit("+Inf").alias("le"), F.col("_inf").alias("n")))
    return counts.select(by, F.inline(bars))


def quantiles(rows: DataFrame, value: str, by: str, exact: bool = True) -> DataFrame:
    """p50 and p95; ``exact`` False uses bounded sketches, for any size."""
    p = (lambda q: F.percentile(value, F.lit(q))) if exact else (lambda q: F.percentile_approx(value, q).cast("double"))
    return rows.groupBy(by).agg(p(0.5).alias("p50"), p(0.95).alias("p95"))


def bucket_quantiles(bars: DataFrame, by: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Quantiles from cumulative buckets (``by``, le, n) as ``histogram`` gives them: (``by``, p50, p95).

    A quantile lies in the first bucket that reaches its share of all, at the place between the bucket's
    edges that its count asks for; the lowest bucket begins at 0, or has one value if its edge is not above 0; in the bucket
    without an end it is the last edge. Buckets of several tables or times may be added up first. NULL where there is no value."""
    edge = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
    rows = bars.groupBy(by, edge.alias("le")).agg(F.sum("n").alias("n"))
    order = Window.partitionBy(by).orderBy("le")
    rows = rows.select(by, "le", "n", F.lag("n", 1, 0).over(order).alias("n0"), F.lag("le").over(order).alias("e0"), F.max("n").over(Window.partitionBy(by)).alias("all"))

    def at(q: float) -> Column:
        rank = F.lit(q) * F.col("all")
        low = F.coalesce("e0", F.when(F.col("le") > 0, F.lit(0.0)).otherwise(F.col("le")))
        inside = low + (F.col("le") - low) * F.try_divide(rank - F.col("n0"), F.col("n") - F.col("n0"))
        value = F.when(F.isnull("e0") & (F.col("le") <= 0), F.col("le")).when(F.col("le") == float("inf"), F.col("e0")).otherwise(F.coalesce(inside, F.col("le")))
        return F.min_by(value, F.when((F.col("n") >= rank) & (F.col("all") > 0), F.col("le"))).alias(f"p{round(100 * q)}")

    return rows.groupBy(by).agg(*map(at, shares))


def sketches(rows: DataFrame, value: str, by: str, at: str, minutes: int = 1) -> DataFrame:
    """A KLL sketch of ``value`` for each group and span of minutes: (``by``, window_start, n, sketch).
    Sketches have a bounded size and merge, so a span of any length needs no value again."""
    spans = rows.filter(F.col(value).isNotNull()).groupBy(by, F.window(at, f"{minutes} minutes").alias("w"))
    return spans.agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("sketch")).select(by, F.col("w.start").alias("window_start"), "n", "sketch")


def sketched_quantiles(stored: DataFrame, by: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Quantiles from ``sketches``, merged over their spans; ranks are right to about 1.3 %."""
    merged = stored.groupBy(by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_s"))
    return merged.select(by, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(q)).alias(f"p{round(100 * q)}") for q in shares])


def latest(rows: DataFrame, key: str, value: str, at: str, tie: str) -> DataFrame:
    """The last ``value`` of each key."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(at, tie)).alias(value))


def depths(events: DataFrame) -> DataFrame:
    """How many jobs wait, run and are dead, from state events (job_id, state, at, seq)."""
    now = latest(events, "job_id", "state", "at", "seq")
    return now.agg(F.count_if(F.col("state").isin("queued", "retry")).alias("pending"), F.count_if(F.col("state") == "claimed").alias("processing"), F.count_if(F.col("state") == "dead_letter").alias("dead"), F.count_if(F.col("state") == "done").alias("done"))


def coverage(labels: DataFrame, adapters: list[str]) -> DataFrame:
    """Category by adapter, the labels each adapter can emit."""
    wide = labels.groupBy("category").pivot("adapter", adapters).agg(F.array_join(F.array_sort(F.collect_set("label")), ","))
    return wide.select("category", *[F.nullif(F.col(a), F.lit("")).alias(a) for a in adapters])


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two models' verdicts on the same key, compared as verdicts: (v1, v2, n)."""
    both = a.select("key", F.col("verdict").alias("v1")).join(b.select("key", F.col("verdict").alias("v2")), "key", "full")
    return both.groupBy(F.coalesce("v1", F.lit("none")).alias("v1"), F.coalesce("v2", F.lit("none")).alias("v2")).agg(F.count("*").alias("n"))


def score_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences of scores, refused where the origins differ: such scores don't compare."""
    x = a.select("key", F.col("score").alias("s1"), F.col("score_origin").alias("o1"))
    y = b.select("key", F.col("score").alias("s2"), F.col("score_origin").alias("o2"))
    bad = F.raise_error(F.concat(F.lit("scores of different origin: "), F.col("o1"), F.lit(", "), F.col("o2")))
    return x.join(y, "key").select("key", F.when(F.col("o1") == F.col("o2"), F.col("s1") - F.col("s2")).otherwise(bad.cast("double")).alias("difference"))


def stranded(claims: DataFrame, beats: DataFrame, now: Column, after: int = 60) -> DataFrame:
    """Claims (job_id, instance_id) whose owner's last heartbeat is older than ``after`` seconds or missing."""
    last = beats.groupBy("instance_id").agg(F.max("at").alias("last_beat"))
    out = claims.join(last, "instance_id", "left")
    return out.filter(F.col("last_beat").isNull() | (F.col("last_beat") < now - F.make_dt_interval(secs=F.lit(after))))


def recent(records: DataFrame, n: int = 200) -> DataFrame:
    """The last ``n`` finished jobs, newest first: a top-k, never a full sort."""
    return records.orderBy(F.desc("finished_at"), F.desc("job_id")).limit(n)


def arrival_order(jobs: DataFrame) -> DataFrame:
    """Start order by arrival within a source partition, never by id."""
    return jobs.withColumn("start_order", F.row_number().over(Window.partitionBy("source_partition").orderBy("enqueue_seq")))


def due(retries: DataFrame, now: Column, most: int = 100) -> DataFrame:
    """Retries (job_id, ready_at, maybe attempt) that are due, oldest first, at most ``most``."""
    ties = ["attempt"] if "attempt" in retries.columns else []
    return retries.filter(F.col("ready_at") <= now).orderBy("ready_at", "job_id", *ties).limit(most)


def outages(outcomes: DataFrame, seconds: int = 60, samples: int = 10, slice_seconds: int = 3600) -> DataFrame:
    """For each adapter the longest run of errors and the worst error share of a trailing
    window with at least ``samples`` outcomes; the window is open at its old end.

    Adapters are few, so their time is cut into slices, each worked on by itself. For the windows a
    slice begins with what is still inside from the slice before it; runs that touch a slice's edges are joined over
    the slices, of which one row each is left by then."""
    length = max(seconds, slice_seconds) * 1_000_000
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    rows = outcomes.select("adapter", "at", "seq", "ok", micros.alias("_t"), F.floor(micros / length).cast("long").alias("_s"))
    order = Window.partitionBy("adapter", "_s").orderBy("at", "seq")
    island = F.row_number().over(order) - F.row_number().over(Window.partitionBy("adapter", "_s", "ok").orderBy("at", "seq"))
    runs = rows.withColumn("_p", F.row_number().over(order)).withColumn("_i", island).groupBy("adapter", "_s", "ok", "_i").agg(F.count("*").alias("n"), F.min("_p").alias("p"))
    bad = ~F.col("ok")
    edges = runs.groupBy("adapter", "_s").agg(F.coalesce(F.max(F.when(bad, F.col("n"))), F.lit(0)).alias("longest"), F.sum("n").alias("n"), F.coalesce(F.max(F.when(bad & (F.col("p") == 1), F.col("n"))), F.lit(0)).alias("lead"), F.max(F.struct("p", F.when(bad, F.col("n")).otherwise(0).alias("n")))["n"].alias("trail"))
    # a slice of errors alone carries the run before it on: a group ends with the slice that doesn't
    over = Window.partitionBy("adapter").orderBy("_s")
    whole = (F.col("lead") == F.col("n")).cast("int")
    grouped = edges.withColumn("_w", whole).withColumn("_g", F.coalesce(F.sum(1 - F.col("_w")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    opened = grouped.groupBy("adapter", "_g").agg(F.sum(F.when(F.col("_w") == 1, F.col("n")).otherwise(F.col("lead"))).alias("first"), F.max(F.when(F.col("_w") == 0, F.col("trail"))).alias("trail"), F.max("longest").alias("longest"))
    carried = opened.withColumn("_c", F.coalesce(F.lag("trail").over(Window.partitionBy("adapter").orderBy("_g")), F.lit(0)))
    longest = carried.groupBy("adapter").agg(F.max(F.greatest("longest", F.col("first") + F.col("_c"))).alias("longest_run"))
    # an outcome enters the windows at its time and leaves them ``seconds`` later, and what is inside
    # is a running sum: frames that move at both ends would add up each window's rows again
    span, one = seconds * 1_000_000, F.lit(1).cast("long")
    moments = rows.filter(F.col("_t").isNotNull()).groupBy("adapter", "_s", "_t").agg(F.count("*").alias("_n"), F.count_if(bad).alias("_e"))
    leaves = F.col("_t") + span
    both = F.array(F.struct(F.col("_t").alias("t"), one.alias("sign")), F.struct(leaves.alias("t"), (-one).alias("sign")))
    ends = moments.select("adapter", "_s", "_n", "_e", F.explode(both).alias("_x")).select("adapter", "_s", F.floor(F.col("_x.t") / length).cast("long").alias("_at"), F.col("_x.t").alias("_t"), (F.col("_n") * F.col("_x.sign")).alias("_n"), (F.col("_e") * F.col("_x.sign")).alias("_e"), (F.col("_x.sign") > 0).alias("_own"))
    # one that leaves in the next slice is inside at that slice's start
    carried_on = ends.filter(F.col("_at") > F.col("_s")).select("adapter", F.col("_at").alias("_s"), (F.col("_at") * length).alias("_t"), (-F.col("_n")).alias("_n"), (-F.col("_e")).alias("_e"), F.lit(False).alias("_own"))
    steps = ends.select("adapter", F.col("_at").alias("_s"), "_t", "_n", "_e", "_own").unionByName(carried_on)
    steps = steps.groupBy("adapter", "_s", "_t").agg(F.sum("_n").alias("_n"), F.sum("_e").alias("_e"), F.max("_own").alias("_own"))
    inside = Window.partitionBy("adapter", "_s").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    rates = steps.withColumn("_n", F.sum("_n").over(inside)).withColumn("_e", F.sum("_e").over(inside)).filter(F.col("_own") & (F.col("_n") >= samples))
    worst = rates.groupBy("adapter").agg(F.max(F.col("_e") / F.col("_n")).alias("worst_rate"))
    return longest.join(worst, "adapter", "left")
