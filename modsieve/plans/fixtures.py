"""Inputs of the registered queries, derived from the given tables; and the same derivations as SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import png
from ..functions.local import local
from ..streaming import intake as I


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.selectExpr(
        "concat('conv-', conv_id) AS asset_id", "conv_id", "turn AS frame_idx", "turn AS frame_ord", "turn * 2.0D AS timestamp_sec", "conv_id * 8 + turn AS k", "if((conv_id * 8 + turn) % 41 = 0, 'error', 'ok') AS status",
        "if((conv_id * 8 + turn) % 41 = 0, concat('frame ', turn, ' failed'), null) AS error", "turn % 2 AS wf_pos", "turn AS wf_idx", "turn % 3 = 0 AS is_keyframe", "if(turn = 0, null, (conv_id * 8 + turn) * 37 % 100 / 100.0D) AS scene",
    )


FRAMES = """frames AS (SELECT concat('conv-', conv_id) AS asset_id, conv_id, turn AS frame_idx, turn AS frame_ord, turn * 2.0::DOUBLE AS timestamp_sec, conv_id * 8 + turn AS k,
 CASE WHEN (conv_id * 8 + turn) % 41 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN (conv_id * 8 + turn) % 41 = 0 THEN concat('frame ', turn, ' failed') END AS error, turn % 2 AS wf_pos, turn AS wf_idx,
 turn % 3 = 0 AS is_keyframe, CASE WHEN turn <> 0 THEN ((conv_id * 8 + turn) * 37 % 100) / 100.0::DOUBLE END AS scene FROM conversations)"""


def assets(spark: SparkSession, sf: str) -> DataFrame:
    """The assets of ``frames`` and five without any."""
    own = table(spark, sf, "conversations").selectExpr("concat('conv-', conv_id) AS asset_id", "conv_id").distinct()
    none = table(spark, sf, "region").selectExpr("concat('conv-', 1000000 + r_regionkey) AS asset_id", "cast(1000000 + r_regionkey AS long) AS conv_id")
    return own.unionByName(none)


ASSETS = """assets AS (SELECT DISTINCT concat('conv-', conv_id) AS asset_id, conv_id FROM conversations UNION ALL SELECT concat('conv-', 1000000 + r_regionkey), 1000000 + r_regionkey FROM region)"""


def severity(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    one = lambda j, name: f"named_struct('category', '{name}', 'severity', CASE WHEN (k * 17 + {j * 251}) % 997 < 8 THEN 6 WHEN (k * 17 + {j * 251}) % 997 < 24 THEN 4 WHEN (k * 17 + {j * 251}) % 997 < 200 THEN 2 ELSE 0 END)"
    listed = ", ".join(one(j, n) for j, n in enumerate(("Hate", "SelfHarm", "Sexual", "Violence")))
    return f.withColumn("response", F.expr(f"to_json(named_struct('categoriesAnalysis', array({listed})))"))


SEVERITY = f"""{FRAMES}, rows AS (SELECT f.*, l.j AS cat_ord, l.label AS provider_label, l.category, CASE WHEN m < 8 THEN 6 WHEN m < 24 THEN 4 WHEN m < 200 THEN 2 ELSE 0 END / 6.0::DOUBLE AS score
 FROM (SELECT *, (k * 17 + j * 251) % 997 AS m FROM frames, (VALUES (0,'Hate','HATE'),(1,'SelfHarm','SELF_HARM'),(2,'Sexual','SEXUAL'),(3,'Violence','VIOLENCE')) l0(j, label, category)) l JOIN frames f USING (asset_id, frame_idx))"""


def likelihood(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    one = lambda j: f"CASE WHEN conv_id % 37 = 0 THEN 'UNKNOWN' WHEN (k * 13 + {j * 211}) % 887 < 9 THEN 'VERY_LIKELY' WHEN (k * 13 + {j * 211}) % 887 < 40 THEN 'LIKELY' WHEN (k * 13 + {j * 211}) % 887 < 110 THEN 'POSSIBLE' WHEN (k * 13 + {j * 211}) % 887 < 400 THEN 'UNLIKELY' WHEN (k * 13 + {j * 211}) % 887 < 800 THEN 'VERY_UNLIKELY' ELSE 'UNKNOWN' END"
    listed = ", ".join(f"'{n}', {one(j)}" for j, n in enumerate(S.LIKELIHOOD_CATEGORIES))
    return f.withColumn("response", F.expr(f"to_json(named_struct({listed}))"))


LIKELIHOOD = f"""{FRAMES}, lik AS (SELECT f.*, j AS cat_ord, category, CASE WHEN conv_id % 37 = 0 THEN 'UNKNOWN' WHEN m < 9 THEN 'VERY_LIKELY' WHEN m < 40 THEN 'LIKELY' WHEN m < 110 THEN 'POSSIBLE' WHEN m < 400 THEN 'UNLIKELY' WHEN m < 800 THEN 'VERY_UNLIKELY' ELSE 'UNKNOWN' END AS lk, field
 FROM (SELECT *, (k * 13 + j * 211) % 887 AS m FROM frames, (VALUES (0,'adult','SEXUAL'),(1,'spoof','SPOOF'),(2,'medical','MEDICAL'),(3,'violence','VIOLENCE'),(4,'racy','SUGGESTIVE_RACY')) l(j, field, category)) f),
 rows AS (SELECT *, concat(field, ':', lk) AS provider_label, CASE lk WHEN 'VERY_UNLIKELY' THEN 0.0 WHEN 'UNLIKELY' THEN 0.25 WHEN 'POSSIBLE' THEN 0.5 WHEN 'LIKELY' THEN 0.75 WHEN 'VERY_LIKELY' THEN 1.0 END::DOUBLE AS score FROM lik)"""

#: The sixteen heads of the multi-head responses and their categories.
HEAD_LIST = [
    ("general_nsfw", "SEXUAL"), ("general_suggestive", "SUGGESTIVE_RACY"), ("gun_in_hand", "WEAPONS"), ("knife_not_in_hand", "WEAPONS"), ("very_bloody", "GORE_GRAPHIC"), ("a_little_bloody", "GORE_GRAPHIC"), ("yes_marijuana", "DRUGS"), ("yes_smoking", "ALCOHOL_TOBACCO"),
    ("yes_gambling", "GAMBLING"), ("yes_middle_finger", "OFFENSIVE_GESTURE"), ("animated", "ANIMATED_SYNTHETIC"), ("medical_injectables", "MEDICAL"), ("yes_female_swimwear", "OTHER"), ("yes_child_present", "OTHER"), ("no_sexual_activity", "OTHER"), ("brand_new_future_head", "OTHER"),
]


def heads(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    one = lambda h, n: f"named_struct('class', if(k % 5 = 0, upper('{n}'), '{n}'), 'score', CASE WHEN (k * 31 + {h * 173}) % 1009 < 2 THEN (900 + (k * 31 + {h * 173}) % 1009) / 1000.0D WHEN (k * 31 + {h * 173}) % 1009 < 10 THEN (550 + (k * 31 + {h * 173}) % 1009) / 1000.0D ELSE (k * 31 + {h * 173}) % 1009 % 390 / 1000.0D END)"
    listed = ", ".join(one(h, n) for h, (n, _) in enumerate(HEAD_LIST))
    return f.withColumn("response", F.expr(f"to_json(named_struct('status', array(named_struct('response', named_struct('output', array(named_struct('time', 0.0D, 'classes', array({listed}))))))))"))


HEADS = f"""{FRAMES}, rows AS (SELECT *, h AS cat_ord, CASE WHEN k % 5 = 0 THEN upper(label) ELSE label END AS provider_label, CASE WHEN m < 2 THEN (900 + m) / 1000.0::DOUBLE WHEN m < 10 THEN (550 + m) / 1000.0::DOUBLE ELSE (m % 390) / 1000.0::DOUBLE END AS score
 FROM (SELECT *, (k * 31 + h * 173) % 1009 AS m FROM frames, (VALUES {", ".join(f"({h},'{n}','{c}')" for h, (n, c) in enumerate(HEAD_LIST))}) l(h, label, category)))"""


def class_map(spark: SparkSession) -> DataFrame:
    return local(spark, S.CLASS_MAP, "label_lc string, category string")


def logprob(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    q = lambda p: f"CASE WHEN (k * 7 + {p * 379}) % 491 < 3 THEN 0.95D WHEN (k * 7 + {p * 379}) % 491 < 14 THEN 0.7D ELSE (1 + (k * 7 + {p * 379}) % 491 % 40) / 100.0D END"
    top = lambda p: f"if(k % 53 = 0, array(named_struct('token', ' Yes', 'logprob', ln({q(p)}))), array(named_struct('token', ' Yes', 'logprob', ln({q(p)})), named_struct('token', 'No ', 'logprob', ln(1 - {q(p)}))))"
    one = lambda p, n: f"named_struct('policy', '{n}', 'response', to_json(named_struct('choices', array(named_struct('logprobs', named_struct('content', array(named_struct('token', 'Yes', 'logprob', 0.0D, 'top_logprobs', {top(p)}))))))))"
    listed = ", ".join(one(p, n) for p, n in enumerate(S.POLICIES))
    return f.select("*", F.expr(f"posexplode(array({listed})) AS (cat_ord, x)")).select("*", "x.policy", "x.response").drop("x")


LOGPROB = f"""{FRAMES}, rows AS (SELECT *, p AS cat_ord, policy AS provider_label, CASE WHEN k % 53 = 0 THEN NULL WHEN m < 3 THEN 0.95 WHEN m < 14 THEN 0.7 ELSE (1 + m % 40) / 100.0 END::DOUBLE AS score
 FROM (SELECT *, (k * 7 + p * 379) % 491 AS m FROM frames, (VALUES (0,'dangerous','WEAPONS'),(1,'sexual','SEXUAL'),(2,'violence','VIOLENCE')) l(p, policy, category)))"""


def hashes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    bits = "aggregate(transform(embedding, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, x) -> a | x)"
    return e.selectExpr("vec_id div 10 AS asset_id", "vec_id % 10 AS frame_idx", f"if(vec_id % 97 = 0, null, {bits}) AS hash")


_BITS = " | ".join(f"(CASE WHEN embedding[{i + 1}] > 0 THEN {(1 << i) if i < 63 else '(-9223372036854775808)'} ELSE 0 END)::BIGINT" for i in range(64))
HASHES = f"hashes AS (SELECT vec_id // 10 AS asset_id, vec_id % 10 AS frame_idx, CASE WHEN vec_id % 97 <> 0 THEN {_BITS} END AS hash FROM embeddings)"


def pictures(spark: SparkSession, sf: str) -> DataFrame:
    """PNG bytes (asset_id, frame_idx, content) of 18 x 16 pixels from each vector: grey, or colours for every third; some cut or missing."""

    @F.pandas_udf("binary")
    def drawn(ids: pd.Series, vectors: pd.Series) -> pd.Series:
        def one(n: int, v: np.ndarray | None) -> bytes | None:
            if v is None or not len(v) or n % 97 == 1:
                return None
            x = np.array([0.0 if c is None else c for c in v], np.float64) if v.dtype == object else v.astype(np.float64)
            level = np.floor((np.clip(np.where(np.isnan(x), 1.0, x), -1, 1) + 1) * 127.5).astype(np.uint8)
            samples = np.arange(3 if n % 3 == 0 else 1)[::-1]  # blue, green, red
            content = png.packed(level[(np.arange(288)[:, None] + samples) % len(level)].reshape(16, 18, -1))
            return content[:60] if n % 97 == 0 else content

        return pd.Series([one(n, v) for n, v in zip(ids, vectors, strict=True)], dtype=object)

    e = table(spark, sf, "embeddings").filter("vec_id is not null")
    return e.select(F.expr("vec_id div 10").alias("asset_id"), (F.col("vec_id") % 10).alias("frame_idx"), drawn("vec_id", "embedding").alias("content"))


def _sample(place: str) -> str:
    return f"v[1 + ({place}) % len(v)]"


PICTURES = """pictures AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 3 ELSE 1 END AS n, vec_id % 97 > 1 AND len(embedding) > 0 AS whole,
 list_transform(embedding, lambda x: coalesce(floor((least(greatest(x::DOUBLE, -1), 1) + 1) * 127.5), 0)::INTEGER) AS v FROM embeddings WHERE vec_id IS NOT NULL)"""
PICTURE_BYTES = f"list_reduce(list_transform(range(288), lambda p: CASE WHEN n = 3 THEN printf('%02X%02X%02X', {_sample('p + 2')}, {_sample('p + 1')}, {_sample('p')}) ELSE printf('%02X', {_sample('p')}) END), lambda a, b: a || b)"
_LUMA = lambda p: f"CASE WHEN n = 3 THEN 0.299::DOUBLE * (257 * {_sample(p)}) + 0.587::DOUBLE * (257 * {_sample(p + ' + 1')}) + 0.114::DOUBLE * (257 * {_sample(p + ' + 2')}) ELSE 0.299::DOUBLE * (257 * {_sample(p)}) + 0.587::DOUBLE * (257 * {_sample(p)}) + 0.114::DOUBLE * (257 * {_sample(p)}) END"
PICTURE_CELLS = f"""{PICTURES}, cells AS (SELECT vec_id, y, x, ({" + ".join(_LUMA(f"(2 * y + {i}) * 18 + 2 * x + {j}") for i in (0, 1) for j in (0, 1))}) / 4 AS m FROM pictures, (SELECT unnest(range(8)) AS y), (SELECT unnest(range(9)) AS x) WHERE whole)"""


def urls(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    n = "page_id % 25"
    return p.selectExpr("page_id", f"CASE {n} WHEN 0 THEN replace(url, '://', '://user:pw@') WHEN 1 THEN 'https:///x.mp4' WHEN 2 THEN substring_index(url, '://', -1) WHEN 3 THEN concat(substring_index(url, '://', 1), '://', upper(split_part(substring_index(url, '://', -1), '/', 1)), substring(substring_index(url, '://', -1), length(split_part(substring_index(url, '://', -1), '/', 1)) + 1)) WHEN 4 THEN concat(substring_index(url, '://', 1), '://', split_part(substring_index(url, '://', -1), '/', 1), ':8443', substring(substring_index(url, '://', -1), length(split_part(substring_index(url, '://', -1), '/', 1)) + 1)) ELSE url END AS url", "url AS clean")


URLS = """urls0 AS (SELECT page_id, url AS clean, split_part(url, '://', 1) AS sch, split_part(split_part(url, '://', 2), '/', 1) AS hst, substr(url, length(split_part(url, '://', 1)) + 4) AS rest FROM pages),
 urls AS (SELECT page_id, clean, CASE page_id % 25 WHEN 0 THEN sch || '://user:pw@' || rest WHEN 1 THEN 'https:///x.mp4' WHEN 2 THEN rest WHEN 3 THEN sch || '://' || upper(hst) || substr(rest, length(hst) + 1) WHEN 4 THEN sch || '://' || hst || ':8443' || substr(rest, length(hst) + 1) ELSE clean END AS url, sch, hst, rest FROM urls0)"""


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    j = e.selectExpr(
        "concat('job-', event_id) AS job_id", "event_id", "user_id", "ts AS finished_at", "CASE WHEN event_id % 211 = 0 THEN 'skip' WHEN event_type IN ('view', 'click') THEN 'allow' WHEN event_type = 'signup' THEN 'flag' WHEN event_type = 'purchase' THEN 'block' ELSE 'error' END AS verdict",
        "if(event_id % 3 = 0, 'video', 'image') AS media_type", "if(event_id % 3 = 0, 1 + user_id % 64, 1) AS frames_scanned", "concat('adapter-', event_id % 3) AS adapter", "concat('i-', user_id % 20) AS instance_id", "value",
    )
    return j.withColumn("frames_flagged", F.expr("if(verdict IN ('flag', 'block'), least(frames_scanned, 1 + event_id % 4), 0)"))


JOBS = """jobs0 AS (SELECT concat('job-', event_id) AS job_id, event_id, user_id, ts AS finished_at, CASE WHEN event_id % 211 = 0 THEN 'skip' WHEN event_type IN ('view', 'click') THEN 'allow' WHEN event_type = 'signup' THEN 'flag' WHEN event_type = 'purchase' THEN 'block' ELSE 'error' END AS verdict,
 CASE WHEN event_id % 3 = 0 THEN 'video' ELSE 'image' END AS media_type, CASE WHEN event_id % 3 = 0 THEN 1 + user_id % 64 ELSE 1 END AS frames_scanned, concat('adapter-', event_id % 3) AS adapter, concat('i-', user_id % 20) AS instance_id, value FROM events),
 jobs AS (SELECT *, CASE WHEN verdict IN ('flag', 'block') THEN least(frames_scanned, 1 + event_id % 4) ELSE 0 END AS frames_flagged FROM jobs0)"""


def redelivered(spark: SparkSession, sf: str) -> DataFrame:
    j = jobs(spark, sf)
    soon = j.filter("event_id % 10 = 0").withColumn("finished_at", F.expr("finished_at + interval 5 minutes"))
    late = j.filter("event_id % 100 = 0").withColumn("finished_at", F.expr("finished_at + interval 3 hours"))
    again = [j.filter("event_id % 50 = 3").withColumn("finished_at", F.expr(f"finished_at + interval {m} minutes")) for m in (50, 100)]
    return j.unionByName(soon).unionByName(late).unionByName(again[0]).unionByName(again[1])


REDELIVERED = f"""{JOBS}, redelivered AS (SELECT * FROM jobs UNION ALL SELECT * REPLACE (finished_at + INTERVAL 5 MINUTE AS finished_at) FROM jobs WHERE event_id % 10 = 0 UNION ALL SELECT * REPLACE (finished_at + INTERVAL 3 HOUR AS finished_at) FROM jobs WHERE event_id % 100 = 0 UNION ALL SELECT * REPLACE (finished_at + INTERVAL 50 MINUTE AS finished_at) FROM jobs WHERE event_id % 50 = 3 UNION ALL SELECT * REPLACE (finished_at + INTERVAL 100 MINUTE AS finished_at) FROM jobs WHERE event_id % 50 = 3)"""


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    rows = jobs(spark, sf).selectExpr("*", "explode(sequence(1L, 1 + event_id % 6)) AS attempt")
    return rows.selectExpr("job_id", "event_id", "adapter", "attempt", "CASE WHEN attempt < 1 + event_id % 6 THEN 'retry' WHEN verdict = 'error' THEN 'dead_letter' ELSE 'ack' END AS disposition", "finished_at + make_dt_interval(0, 0, attempt) AS at", "CASE event_id % 7 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN null ELSE 200 END AS status", "if(event_id % 2 = 0, cast(event_id % 200 AS int), null) AS retry_after")


ATTEMPTS = f"""{JOBS}, attempts AS (SELECT job_id, event_id, adapter, attempt, CASE WHEN attempt < 1 + event_id % 6 THEN 'retry' WHEN verdict = 'error' THEN 'dead_letter' ELSE 'ack' END AS disposition, finished_at + to_minutes(attempt::INTEGER) AS at,
 CASE event_id % 7 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN NULL ELSE 200 END AS status, CASE WHEN event_id % 2 = 0 THEN (event_id % 200)::INTEGER END AS retry_after FROM (SELECT *, unnest(range(1, 2 + event_id % 6)) AS attempt FROM jobs))"""


def intake(spark: SparkSession, sf: str) -> DataFrame:
    """What happens to a queue for each adapter: every job arrives, allowed ones are taken ten minutes later; the rest change the control state."""
    j = jobs(spark, sf)
    arrivals = j.selectExpr("adapter AS queue", "finished_at AS at", "event_id AS seq", "job_id", "if(verdict = 'skip', 'kind', null) AS bad_request")
    taken = j.filter("verdict = 'allow'").selectExpr("adapter AS queue", "finished_at + interval 10 minutes AS at", "event_id AS seq")
    changes = j.filter("verdict <> 'allow'").selectExpr("adapter AS queue", "finished_at AS at", "event_id AS seq", "if(verdict = 'flag' and user_id % 4 = 0, event_id % 8 = 0, null) AS tripped", "if(verdict = 'block' and user_id % 4 = 1, event_id % 6 = 1, null) AS paused", "CASE verdict WHEN 'error' THEN 1 WHEN 'block' THEN -1 ELSE 0 END AS letters")
    return I.events(arrivals, changes, taken)


INTAKE = f"""{JOBS}, intake AS (SELECT adapter AS queue, finished_at AS "at", 2 AS kind, event_id AS seq, job_id, CASE WHEN verdict = 'skip' THEN 'kind' END AS bad, NULL::BOOLEAN AS tripped, NULL::BOOLEAN AS paused, 0 AS letters FROM jobs
 UNION ALL SELECT adapter, finished_at + INTERVAL 10 MINUTE, 1, event_id, NULL, NULL, NULL, NULL, 0 FROM jobs WHERE verdict = 'allow'
 UNION ALL SELECT adapter, finished_at, 0, event_id, NULL, NULL, CASE WHEN verdict = 'flag' AND user_id % 4 = 0 THEN event_id % 8 = 0 END, CASE WHEN verdict = 'block' AND user_id % 4 = 1 THEN event_id % 6 = 1 END, CASE verdict WHEN 'error' THEN 1 WHEN 'block' THEN -1 ELSE 0 END FROM jobs WHERE verdict <> 'allow')"""


def payload(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions to append, a chain for each user."""
    j = jobs(spark, sf)
    own = "map('adapter', adapter, 'asset_id', concat('asset-', event_id), 'config_hash', sha2(adapter, 256), 'job_id', job_id, 'model_version', '1', 'raw_sha256', sha2(job_id, 256), 'verdict', verdict)"
    return j.selectExpr("user_id AS chain_id", "event_id AS ord", "date_format(finished_at, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000Z'\") AS timestamp", f"{own} AS payload")


PAYLOAD = f"""{JOBS}, audit0 AS (SELECT user_id AS chain_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, strftime(finished_at, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS ts, '{{"adapter":"' || adapter || '","asset_id":"asset-' || event_id || '","config_hash":"' || sha256(adapter) || '","job_id":"' || job_id || '","model_version":"1","raw_sha256":"' || sha256(job_id) || '","verdict":"' || verdict || '"}}' AS canon FROM jobs),
 chain AS (WITH RECURSIVE c(chain_id, seq, prev_hash, entry_hash) AS (SELECT chain_id, seq, repeat('0', 64), sha256(unhex(lpad(to_hex(seq), 16, '0')) || unhex(lpad(to_hex(strlen(ts)), 16, '0')) || encode(ts) || unhex(repeat('0', 64)) || unhex(lpad(to_hex(strlen(canon)), 16, '0')) || encode(canon)) FROM audit0 WHERE seq = 1
  UNION ALL SELECT a.chain_id, a.seq, c.entry_hash, sha256(unhex(lpad(to_hex(a.seq), 16, '0')) || unhex(lpad(to_hex(strlen(a.ts)), 16, '0')) || encode(a.ts) || unhex(c.entry_hash) || unhex(lpad(to_hex(strlen(a.canon)), 16, '0')) || encode(a.canon)) FROM c JOIN audit0 a ON a.chain_id = c.chain_id AND a.seq = c.seq + 1) SELECT * FROM c)"""
