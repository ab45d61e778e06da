"""Hash-chained audit records: canonical text, appending, verification, anchors, signatures."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GENESIS = "0" * 64


def _quoted(s: Column) -> Column:
    """A JSON string with the least escaping; U+2028 and U+2029 are escaped too."""
    plain = ~F.regexp_like(s, F.lit("[\"\\\\\\x00-\\x1f\\x7f\u2028\u2029]"))
    body = F.regexp_extract(F.to_json(F.struct(s.alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(plain, F.concat(F.lit('"'), s, F.lit('"'))).otherwise(F.replace(F.replace(body, F.lit("\u2028"), F.lit("\\u2028")), F.lit("\u2029"), F.lit("\\u2029")))


def canonical(payload: Column) -> Column:
    """A flat map of strings as JSON with sorted keys."""
    items = F.transform(F.array_sort(F.map_entries(payload)), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), _quoted(e["value"])))
    return F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}"))


def _eight(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def entry_hash(seq: Column, timestamp: Column, prev: Column, payload: Column) -> Column:
    """SHA-256 over sequence, time, previous hash and canonical payload, texts with their lengths."""
    text = lambda s: F.concat(_eight(F.octet_length(s)), F.encode(s, "UTF-8"))
    return F.sha2(F.concat(_eight(seq), text(timestamp), F.unhex(prev), text(canonical(payload))), 256)


def verify(records: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """For each chain the first broken seq (NULL if none) and the records valid before it.

    Every record is checked against its own fields in parallel; only ``lag`` needs a chain's order.
    ``start`` has the verified ends (chain_id, seq, entry_hash) of chains: of these, the records from that
    end on are enough, and ``n_valid`` counts the records after it."""
    order = Window.partitionBy("chain_id").orderBy("seq")
    if start is None:
        rows = records.withColumn("_s", F.lit(0).cast("long")).withColumn("_h", F.lit(GENESIS))
    else:
        rows = records.join(start.select("chain_id", F.col("seq").alias("_s"), F.col("entry_hash").alias("_h")), "chain_id", "left")
        rows = rows.withColumns({"_s": F.coalesce("_s", F.lit(0).cast("long")), "_h": F.coalesce("_h", F.lit(GENESIS))}).filter("seq >= _s or seq is null")
    # the end itself is there again, to be checked against what was stored of it; a chain without one starts at 0
    ended = (F.col("_s") > 0).cast("long")
    placed = rows.withColumn("_place", F.row_number().over(order) - ended).withColumn("_before", F.lag("entry_hash").over(order))
    own = entry_hash(F.col("seq"), F.col("timestamp"), F.col("prev_hash"), F.col("payload"))
    linked = F.when(F.col("_place") > 0, F.col("prev_hash") == F.coalesce("_before", "_h")).otherwise(F.col("entry_hash") == F.col("_h"))
    good = (F.col("seq") == F.col("_s") + F.col("_place")) & linked & (F.col("entry_hash") == own)
    checked = placed.withColumn("_bad", ~F.coalesce(good, F.lit(False)))
    found = checked.groupBy("chain_id").agg(F.min(F.when(F.col("_bad"), F.col("seq"))).alias("first_broken"), F.min(F.when(F.col("_bad"), F.col("_place"))).alias("_at"), F.max("_place").alias("n"))
    return found.select("chain_id", "first_broken", F.greatest(F.coalesce(F.col("_at") - 1, F.col("n")), F.lit(0)).cast("long").alias("n_valid"))


def anchors(records: DataFrame, heads: DataFrame) -> DataFrame:
    """Each chain against its head: ok, truncated, rewritten or unanchored. A chain with a head
    and no records at all is truncated; one that goes on past its head is ok, as a stop between the
    append and the head's update leaves it so."""
    ends = records.groupBy("chain_id").agg(F.max("seq").alias("_last"))
    at = records.select("chain_id", "seq", F.col("entry_hash").alias("_own"))
    named = heads.filter("seq > 0").select("chain_id", "seq", F.col("entry_hash").alias("_head"))
    out = ends.join(named, "chain_id", "full").join(at, ["chain_id", "seq"], "left")
    status = F.when(F.col("_head").isNull(), "unanchored").when(F.coalesce("_last", F.lit(0)) < F.col("seq"), "truncated").when(F.coalesce(F.col("_own") != F.col("_head"), F.lit(True)), "rewritten").otherwise("ok")
    return out.select("chain_id", status.alias("status"))


def unseen(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` (chain_id, kind, ord, payload) to append: events always, decisions
    if their job is neither in the chain nor earlier in the batch."""
    job = F.col("payload")["job_id"]
    old = stored.filter(job.isNotNull()).select("chain_id", job.alias("_job")).distinct()
    placed = batch.withColumn("_job", job)
    named = placed.filter("_job is not null")
    rank = F.row_number().over(Window.partitionBy("chain_id", "_job").orderBy("ord"))
    first = named.withColumn("_n", rank)
    new = first.filter("kind = 'event' or _n = 1").drop("_n")
    decisions = new.filter("kind = 'decision'").join(old, ["chain_id", "_job"], "left_anti")
    plain = placed.filter("_job is null")
    return decisions.unionByName(new.filter("kind = 'event'")).unionByName(plain).drop("_job")


def append(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Chained records of rows (chain_id, ord, timestamp, payload), continuing from heads
    (chain_id, seq, entry_hash). A chain is serial, chains are parallel: keep them many and short."""
    start = rows.join(heads.select("chain_id", F.col("seq").alias("_seq"), F.col("entry_hash").alias("_hash")), "chain_id", "left")
    ready = start.select("chain_id", "ord", "timestamp", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("payload")))).alias("p"), canonical(F.col("payload")).alias("canon"), F.coalesce("_seq", F.lit(0)).cast("long").alias("seq0"), F.coalesce("_hash", F.lit(GENESIS)).alias("hash0"))

    def chain(batches):
        at, seq, prev = None, 0, ""
        for pdf in batches:
            out = []
            for c, t, text, p, seq0, hash0 in zip(pdf.chain_id, pdf.timestamp, pdf.canon, pdf.p, pdf.seq0, pdf.hash0, strict=True):
                if c != at:
                    at, seq, prev = c, int(seq0), hash0
                seq += 1
                time, body = t.encode(), text.encode()
                own = hashlib.sha256(seq.to_bytes(8, "big") + len(time).to_bytes(8, "big") + time + bytes.fromhex(prev) + len(body).to_bytes(8, "big") + body).hexdigest()
                out.append((c, seq, t, prev, p, own))
                prev = own
            yield pd.DataFrame(out, columns=["chain_id", "seq", "timestamp", "prev_hash", "p", "entry_hash"])

    # a chain's rows stream through one task in order; only its end is kept
    placed = ready.repartition("chain_id").sortWithinPartitions("chain_id", "ord")
    done = placed.mapInPandas(chain, "chain_id long, seq long, timestamp string, prev_hash string, p string, entry_hash string")
    return done.select("chain_id", "seq", "timestamp", "prev_hash", F.from_json("p", "map<string,string>").alias("payload"), "entry_hash", F.lit(None).cast("string").alias("signature"))


def heads_of(records: DataFrame) -> DataFrame:
    """The anchor each chain should have: (chain_id, seq, entry_hash) of its last record."""
    return records.groupBy("chain_id").agg(F.max("seq").alias("seq"), F.max_by("entry_hash", "seq").alias("entry_hash"))


def _hmac(key: bytes):
    @F.pandas_udf("string")
    def sign(hashes: pd.Series) -> pd.Series:
        return hashes.map(lambda h: hmac.new(key, h.encode(), hashlib.sha256).hexdigest())

    return sign


def signed(records: DataFrame, key: bytes) -> DataFrame:
    """records with an HMAC-SHA256 signature over their entry hash."""
    return records.withColumn("signature", _hmac(key)(F.col("entry_hash")))


def bad_signatures(records: DataFrame, key: bytes) -> DataFrame:
    """records whose signature is missing or wrong."""
    return records.filter(F.col("signature").isNull() | (F.col("signature") != _hmac(key)(F.col("entry_hash"))))
