"""W4, W10, A11 live: the last finished jobs, the latest state of each key and how many are in each state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor
from pyspark.sql.types import StructType

from ..operators import ops
from ..sources import commits
from .live import current_batch

#: Keys of the state of the last finished jobs: each holds its own last ``n``.
SHARDS = 16


class _Recent(StatefulProcessor):
    """W4 by shard: its last ``n`` records as a list, and which of a batch's rows are among them."""

    def __init__(self, columns: list[str], n: int) -> None:
        self.columns, self.n = columns, n

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getListState("last", "at long, job_id string")

    def handleInputRows(self, key, rows, timers):  # noqa: N802
        # a record without a time comes after all that have one
        rank = lambda at, job: (at is not None, at or 0, job is not None, job or "")
        own = [(rank(at, job), None) for at, job in (self.state.get() if self.state.exists() else ())]
        for pdf in rows:
            given = [(rank(None if pd.isna(t) else int(t), None if pd.isna(j) else j), r) for t, j, r in zip(pdf["micros_"], pdf["job_id"], pdf[self.columns].itertuples(index=False), strict=True)]
            own = sorted(own + given, key=lambda x: x[0], reverse=True)[: self.n]
        self.state.put([(r[1] if r[0] else None, r[3] if r[2] else None) for r, _ in own])
        new = [r for _, r in own if r is not None]
        if new:
            yield pd.DataFrame(new, columns=self.columns)

    def close(self) -> None:
        pass


def recent(records: DataFrame, n: int = 200, shards: int = SHARDS) -> DataFrame:
    """Of a stream of finished jobs, the rows that are among the last ``n`` of their shard when they come, so every
    row that ``ops.recent`` would hold then, and few others; ``ring`` keeps the last ``n`` of them. Needs the RocksDB state store provider. State is
    ``shards`` lists of at most ``n`` times and ids, whatever has passed."""
    names = records.columns
    rows = records.withColumn("micros_", F.unix_micros(F.col("finished_at").cast("timestamp"))).withColumn("shard_", F.pmod(F.xxhash64("job_id"), F.lit(shards)))
    return rows.groupBy("shard_").transformWithStateInPandas(_Recent(names, n), records.schema, "Append", "None")


def ring(records: DataFrame, path: str, n: int = 200) -> DataStreamWriter:
    """Keeps the table at ``path`` equal to ``ops.recent`` of all records so far, after every micro-batch and once
    for each; ``tracked`` reads it."""
    schema = records.schema

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        merge = lambda now: ops.recent(commits.read(spark, path, schema).unionByName(df), n).coalesce(1)
        commits.append(spark, path, merge, current_batch(spark), snapshot=lambda _: True)

    return recent(records, n).writeStream.foreachBatch(batch)


def tracked(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``ring`` keeps, newest first."""
    return ops.recent(commits.read(spark, path, schema))


class _Latest(StatefulProcessor):
    """W10 by key: its state and when it came."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("latest", "at long, seq long, state string")

    def handleInputRows(self, key, rows, timers):  # noqa: N802
        best = was = tuple(self.state.get()) if self.state.exists() else None
        rank = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)
        for pdf in rows:
            for at, seq, state in zip(pdf["micros_"], pdf["seq"], pdf["state"], strict=True):
                r = (None if pd.isna(at) else int(at), None if pd.isna(seq) else int(seq), None if pd.isna(state) else state)
                if best is None or rank(r) >= rank(best):
                    best = r
        if best == was:
            return
        self.state.update(best)
        at = pd.NaT if best[0] is None else pd.Timestamp(best[0], unit="us")
        yield pd.DataFrame({"key": [key[0]], "state": pd.Series([best[2]], dtype=object), "at": pd.Series([at], dtype="datetime64[us]"), "seq": pd.Series([best[1]], dtype="Int64"), "was": pd.Series([was[2] if was else None], dtype=object), "first": [was is None]})

    def close(self) -> None:
        pass


def latest(events: DataFrame) -> DataFrame:
    """Of a stream (key, state, at, seq), a row (key, state, at, seq, was, first) for each key whose latest state changed in a micro-batch;
    ``was`` is the state before it and ``first`` tells that there was none. An event older than the state held changes
    nothing; of equal (at, seq) the last to come counts. Needs the RocksDB state store provider; state is one row a key."""
    rows = events.select("key", F.col("state").cast("string").alias("state"), F.unix_micros(F.col("at").cast("timestamp")).alias("micros_"), F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("key").transformWithStateInPandas(_Latest(), "key string, state string, at timestamp, seq long, was string, first boolean", "Append", "None")


DEPTHS = "state string, n long"


def depths(events: DataFrame, path: str) -> DataStreamWriter:
    """Keeps at ``path`` how many keys are in each state (state, n), once for each micro-batch. Only changes are counted: a key adds
    one to its state and takes one from the state that it leaves, so no batch reads all keys. ``depths_now`` reads it."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        moves = df.select("state", F.lit(1).cast("long").alias("n")).unionByName(df.filter("not first").select(F.col("was").alias("state"), F.lit(-1).cast("long").alias("n")))
        merge = lambda now: commits.read(spark, path, DEPTHS).unionByName(moves).groupBy("state").agg(F.sum("n").alias("n")).filter("n <> 0").coalesce(1)
        commits.append(spark, path, merge, current_batch(spark), snapshot=lambda _: True)

    return latest(events).writeStream.foreachBatch(batch)


def depths_now(spark: SparkSession, path: str) -> DataFrame:
    return commits.read(spark, path, DEPTHS)
