"""The registered moderation queries: each operator over its fixture, with DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas as S
from ..functions import admission as A
from ..functions import normalize as N
from ..functions import png
from ..functions.local import local
from ..operators import audit, ops, scoring
from ..operators import frames as FR
from ..operators import thresholds as T
from ..operators import verdict as V
from ..sources import readers, sinks
from ..streaming import batch as B
from ..streaming import intake as I
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _values(rows) -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


DEFAULTS = f"(VALUES {_values(S.DEFAULT_THRESHOLDS)}) th(key, flag_at, block_at)"
LABELLED = [("label:violence", 0.35, None), ("label:hate", None, 0.6), ("label:selfharm", 0.2, 0.3)]


def _resolved(values: str) -> str:
    pick = lambda c: f"coalesce((SELECT {c} FROM th WHERE key = 'label:' || lower(provider_label)), (SELECT {c} FROM th WHERE key = category), (SELECT {c} FROM th WHERE key = 'default'))"
    return f"th AS (SELECT * FROM {values}), res AS (SELECT *, {pick('flag_at')} AS flag_at, {pick('block_at')} AS block_at FROM rows)"


#: The verdict by ranked rows and correlated checks, unlike the aggregation it is compared with.
VERDICT = """, fl AS (SELECT *, coalesce(score >= flag_at, false) AS flagged FROM res), best AS (SELECT asset_id, category, score FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY score DESC, frame_ord, cat_ord) AS rn FROM fl WHERE status = 'ok' AND score IS NOT NULL) WHERE rn = 1),
 per AS (SELECT asset_id, count(*) AS n_frames, count(*) FILTER (status <> 'ok') AS n_errors FROM frames GROUP BY 1)
SELECT p.asset_id, CASE WHEN EXISTS (SELECT 1 FROM fl WHERE fl.asset_id = p.asset_id AND status = 'ok' AND score >= block_at) THEN 'block' WHEN n_errors > 0 OR n_errors = n_frames OR b.score IS NULL THEN 'error'
 WHEN EXISTS (SELECT 1 FROM fl WHERE fl.asset_id = p.asset_id AND status = 'ok' AND flagged) THEN 'flag' ELSE 'allow' END AS verdict, EXISTS (SELECT 1 FROM fl WHERE fl.asset_id = p.asset_id AND status = 'ok' AND flagged) AS flagged,
 b.category AS top_category, b.score AS max_score, b.score AS confidence, n_frames, n_errors FROM per p LEFT JOIN best b USING (asset_id)"""


def _verdicts(rows: DataFrame, frames: DataFrame, thresholds: DataFrame) -> DataFrame:
    return V.roll_up(frames.select("asset_id", "frame_ord", "status"), T.apply(T.resolve(rows, thresholds)))


# --- sources -------------------------------------------------------------------------------------


@query(f"""WITH {X.URLS}, m AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'url' ELSE 'file' END AS kind, CASE WHEN page_id % 2 = 0 THEN clean ELSE '/data/' || page_id || CASE page_id % 3 WHEN 0 THEN '.MP4' WHEN 1 THEN '.png' ELSE '.ts' END END AS ref FROM urls)
SELECT 'job-' || page_id AS job_id, kind, CASE WHEN kind = 'url' THEN regexp_replace(ref, '[?#].*$', '') ELSE ref END AS ref, CASE WHEN kind = 'url' THEN sha256(ref) END AS ref_digest,
 CASE WHEN kind = 'file' AND page_id % 3 IN (0, 2) THEN 'video' ELSE 'image' END AS media_type, CASE WHEN page_id % 4 = 0 THEN 'keyframe' ELSE 'interval' END AS workflows, CASE WHEN page_id % 7 = 0 THEN (page_id % 12)::INTEGER END AS dedup_threshold FROM m""")
def s1_jobs(spark, sf):
    p = X.table(spark, sf, "pages").selectExpr("page_id", "to_json(named_struct('id', concat('job-', page_id), 'kind', if(page_id % 2 = 0, 'url', 'file'), 'ref', if(page_id % 2 = 0, url, concat('/data/', page_id, CASE page_id % 3 WHEN 0 THEN '.MP4' WHEN 1 THEN '.png' ELSE '.ts' END)), 'workflows', if(page_id % 4 = 0, array('keyframe'), array()), 'dedup_threshold', if(page_id % 7 = 0, page_id % 12, null))) AS value")
    rows = p.select(F.from_json("value", S.MANIFEST).alias("m")).select("m.*")
    return readers.manifest(rows).withColumn("workflows", F.array_join("workflows", ",")).drop("metadata")


@query("""SELECT concat('conv-', conv_id) AS asset_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame_idx, CASE WHEN turn < 3 THEN turn * 1.5::DOUBLE ELSE turn::DOUBLE END AS timestamp_sec, 'frame-' || lpad(turn::VARCHAR, 6, '0') AS path FROM conversations""")
def s4_frame_ts(spark, sf):
    c = X.table(spark, sf, "conversations")
    listing = c.selectExpr("concat('conv-', conv_id) AS asset_id", "concat('frame-', lpad(turn, 6, '0')) AS path")
    logs = c.filter("turn < 3").groupBy(F.expr("concat('conv-', conv_id)").alias("asset_id")).agg(F.array_sort(F.collect_list(F.expr("turn * 1.5D"))).alias("ts"))
    return FR.paired(listing, logs)


@query("SELECT concat('conv-', conv_id) AS asset_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame_idx, turn * 0.5::DOUBLE AS timestamp_sec FROM conversations")
def s5_pts_log(spark, sf):
    line = F.expr("concat('[Parsed_showinfo @ 0x1] n:', turn, ' pts:', turn * 500, ' pts_time:', turn * 0.5D, ' fmt:rgb24')")
    c = X.table(spark, sf, "conversations").groupBy(F.expr("concat('conv-', conv_id)").alias("asset_id"))
    return FR.log_times(c.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("value")))


def _envelopes(spark, sf) -> DataFrame:
    f = X.severity(spark, sf)
    rows = T.apply(T.resolve(N.severity(f), T.defaults(spark)))
    v = V.roll_up(f.select("asset_id", "frame_ord", "status"), rows)
    jobs = X.assets(spark, sf).join(v.select("asset_id"), "asset_id", "left_semi").selectExpr("asset_id AS job_id", "'file' AS kind", "asset_id AS ref", "cast(null AS string) AS ref_digest", "'video' AS media_type", "if(conv_id % 2 = 0, '{\"a\":1}', null) AS metadata", "timestamp '2024-01-01 00:00:00' AS started_at", "timestamp '2024-01-01 00:00:01' AS finished_at")
    return V.envelopes(jobs, v, f, rows, "severity", "1", F.lit("0" * 64))


@query(f"""WITH {X.SEVERITY}, {_resolved(DEFAULTS)}{VERDICT.replace("SELECT p.asset_id,", ", v AS (SELECT p.asset_id,", 1)})
SELECT asset_id AS job_id, verdict, top_category, max_score, CASE WHEN verdict = 'error' THEN (SELECT coalesce(nullif(string_agg(error, '; ' ORDER BY frame_idx), ''), 'could not evaluate') FROM frames f WHERE f.asset_id = v.asset_id AND status = 'error') END AS error FROM v""")
def s7_envelopes(spark, sf):
    text = sinks.envelope_json(_envelopes(spark, sf))
    return readers.verdict_of(text.select(F.from_json("value", S.ENVELOPE).alias("e")).select("e.*"))


# --- sinks ---------------------------------------------------------------------------------------


def _json(*parts: str) -> str:
    return " || ".join(parts)


#: Envelopes as text, put together from rows by string aggregation.
ENVELOPES = f"""WITH {X.SEVERITY}, {_resolved(DEFAULTS)}{VERDICT.replace("SELECT p.asset_id,", ", v AS (SELECT p.asset_id,", 1)}),
 cats AS (SELECT asset_id, frame_idx, string_agg({_json("'{\"category\":\"'", "category", "'\",\"provider_label\":\"'", "provider_label", "'\",\"score\":'", "score", "',\"score_origin\":\"severity\",\"threshold\":'", "flag_at", "',\"flagged\":'", "coalesce(score >= flag_at, false)", "'}'")}, ',' ORDER BY cat_ord) AS c FROM res GROUP BY 1, 2),
 fr AS (SELECT f.asset_id, string_agg({_json("'{\"timestamp_sec\":'", "timestamp_sec", "',\"status\":\"'", "status", "'\"'", "coalesce(',\"error\":\"' || error || '\"', '')", "',\"categories\":['", "CASE WHEN status = 'ok' THEN c ELSE '' END", "']}'")}, ',' ORDER BY timestamp_sec, frame_ord) AS fs, string_agg(error, '; ' ORDER BY frame_ord) AS texts FROM frames f JOIN cats USING (asset_id, frame_idx) GROUP BY 1)
SELECT asset_id AS job_id, {_json("'{\"job_id\":\"'", "asset_id", "'\",\"source\":{\"kind\":\"file\",\"ref\":\"'", "asset_id", "'\",\"media_type\":\"video\"},\"model_id\":{\"adapter\":\"severity\",\"model_version\":\"1\",\"config_hash\":\"'", "repeat('0', 64)", f"'\"}},\"result\":{{\"schema_version\":\"{S.VERSION}\",\"provider\":\"severity\",\"model_version\":\"1\",\"media_type\":\"video\",\"asset_id\":\"'", "asset_id", "'\",\"frames\":['", "fs", "'],\"overall\":{\"verdict\":\"'", "verdict", "'\",\"flagged\":'", "flagged", "',\"top_category\":'", "coalesce('\"' || top_category || '\"', 'null')", "',\"max_score\":'", "coalesce(max_score::VARCHAR, 'null')", "',\"confidence\":'", "coalesce(confidence::VARCHAR, 'null')", "'}}'", "CASE WHEN verdict = 'error' THEN ',\"error\":\"' || coalesce(texts, 'could not evaluate') || '\"' ELSE '' END", "CASE WHEN split_part(asset_id, '-', 2)::BIGINT % 2 = 0 THEN ',\"metadata\":{\"a\":1}' ELSE '' END", "',\"started_at\":\"2024-01-01T00:00:00.000000Z\",\"finished_at\":\"2024-01-01T00:00:01.000000Z\"}'")} AS value FROM v JOIN fr USING (asset_id)"""


@query(ENVELOPES)
def k1_envelope_json(spark, sf):
    return sinks.envelope_json(_envelopes(spark, sf))


@query(f"WITH {X.REDELIVERED} SELECT job_id, min(finished_at) AS finished_at, any_value(verdict) AS verdict FROM redelivered WHERE event_id % 7 <> 0 GROUP BY job_id")
def k2_idempotent(spark, sf):
    stored = X.jobs(spark, sf).filter("event_id % 7 = 0")
    return sinks.fresh(X.redelivered(spark, sf), stored).select("job_id", "finished_at", "verdict")


@query(f"""WITH {X.ATTEMPTS} SELECT job_id, 'could not evaluate' AS reason, attempt AS attempts, "at" FROM attempts WHERE disposition = 'dead_letter'""")
def k5_dead_letters(spark, sf):
    return sinks.dead_letters(X.attempts(spark, sf).selectExpr("job_id", "disposition", "attempt AS attempts", "at", "cast(null AS string) AS error"))


# --- normalisation -------------------------------------------------------------------------------


@query(f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'OTHER' WHEN 1 THEN 'MEDICAL' WHEN 2 THEN 'HATE' ELSE 'OTHER' END AS category, event_id % 4 = 1 AS is_provenance FROM events")
def p1_canonicalize(spark, sf):
    e = X.table(spark, sf, "events").selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN 'hate' WHEN 1 THEN 'MEDICAL' WHEN 2 THEN 'HATE' ELSE event_type END AS raw")
    c = N.canonical(F.col("raw"))
    return e.select("event_id", c.alias("category"), N.is_provenance(c).alias("is_provenance"))


_ROWS = "asset_id", "frame_idx", "cat_ord", "category", "provider_label", "score", "score_origin"


@query(f"WITH {X.SEVERITY} SELECT asset_id, frame_idx, cat_ord, category, provider_label, score, 'severity' AS score_origin FROM rows")
def p2_severity(spark, sf):
    return N.severity(X.severity(spark, sf)).select(*_ROWS)


@query(f"WITH {X.LIKELIHOOD} SELECT asset_id, frame_idx, cat_ord, category, provider_label, score, 'likelihood_enum' AS score_origin FROM rows")
def p3_likelihood(spark, sf):
    return N.likelihood(X.likelihood(spark, sf)).select(*_ROWS)


@query(f"WITH {X.HEADS} SELECT asset_id, frame_idx, cat_ord, category, provider_label, score, 'probability' AS score_origin FROM rows")
def p4_heads(spark, sf):
    return N.heads(X.heads(spark, sf), X.class_map(spark)).select(*_ROWS)


@query(f"WITH {X.LOGPROB} SELECT asset_id, frame_idx, provider_label, round(score, 9) AS score FROM rows")
def p5_yes_prob(spark, sf):
    return N.policies(X.logprob(spark, sf)).select("asset_id", "frame_idx", "provider_label", F.round("score", 9).alias("score"))


@query(f"WITH {X.LOGPROB} SELECT asset_id, frame_idx, provider_label, CASE WHEN k % 53 = 0 THEN 'error' ELSE status END AS status, score IS NULL AS missing FROM rows")
def p6_policy_complete(spark, sf):
    return N.policies(X.logprob(spark, sf)).select("asset_id", "frame_idx", "provider_label", "status", F.col("score").isNull().alias("missing"))


@query(f"WITH {X.SEVERITY}, {_resolved(DEFAULTS)} SELECT asset_id, frame_idx, cat_ord, flag_at AS threshold, coalesce(score >= flag_at, false) AS flagged FROM res")
def p7_flags(spark, sf):
    return T.apply(T.resolve(N.severity(X.severity(spark, sf)), T.defaults(spark))).select("asset_id", "frame_idx", "cat_ord", "threshold", "flagged")


# --- admission -----------------------------------------------------------------------------------


@query(f"""SELECT event_id, CASE WHEN cap > 0 AND n > cap THEN concat('image is ', n, ' bytes, over the limit of ', cap) END AS preflight_error FROM (SELECT event_id, event_id * 1000 AS n, CASE event_id % 4 WHEN 0 THEN 4194304 WHEN 3 THEN 0 ELSE 20971520 END AS cap FROM events)""")
def p8_preflight(spark, sf):
    caps = local(spark, list(S.IMAGE_CAPS.items()), "adapter string, max_bytes long")
    e = X.table(spark, sf, "events").selectExpr("event_id", "event_id * 1000 AS n_bytes", "element_at(array('severity', 'likelihood', 'heads', 'logprob'), cast(event_id % 4 + 1 AS int)) AS adapter")
    return A.oversize(e, caps).select("event_id", "preflight_error")


_EXT = ("mp4", "MOV", "png", "webm", "jpeg", "Ts", "txt", "mpeg", "m4v", "gif")


@query(f"SELECT event_id, CASE WHEN event_id % 10 IN (0, 1, 3, 5, 7, 8) THEN 'video' ELSE 'image' END AS media_type FROM events")
def p9_media_type(spark, sf):
    e = X.table(spark, sf, "events").selectExpr("event_id", f"concat('/a.mp4/', event_id, '.', element_at(array{_EXT}, cast(event_id % 10 + 1 AS int))) AS ref")
    return e.select("event_id", A.media_type(F.col("ref")).alias("media_type"))


#: The first bytes of files, by the type they tell.
_HEADS = [("89504E470D0A1A0A", "image/png"), ("FFD8FFE1", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("524946460102030457454250", "image/webp"), ("0000001866747970", "video/mp4"), ("1A45DFA3", "video/webm"), ("474946383861", "application/octet-stream"), ("", "application/octet-stream")]


@query(f"SELECT event_id, CASE event_id % {len(_HEADS)} {' '.join(f'WHEN {i} THEN {chr(39)}{t}{chr(39)}' for i, (_, t) in enumerate(_HEADS))} END AS mime FROM events")
def p10_mime(spark, sf):
    heads = F.array(*[F.lit(h) for h, _ in _HEADS])
    content = F.concat(F.unhex(F.element_at(heads, (F.col("event_id") % len(_HEADS) + 1).cast("int"))), F.col("props").cast("binary"))
    return X.table(spark, sf, "events").select("event_id", A.mime(content).alias("mime"))


_HOSTED = "h AS (SELECT *, lower(regexp_replace(regexp_replace(CASE WHEN page_id % 25 = 1 THEN '' WHEN page_id % 25 = 2 THEN '' ELSE hst END, '^.*@', ''), ':[0-9]*$', '')) AS host FROM urls)"
_REASON = "CASE WHEN page_id % 25 = 0 THEN 'userinfo' WHEN host = '' THEN 'no_host' WHEN NOT (length(host) % 2 = 0 OR host LIKE 'blog.%') THEN 'host' WHEN NOT (sch = 'https' OR sch = 'http' AND host LIKE 'blog.%') THEN 'scheme' END"


def _admitted(spark, sf) -> DataFrame:
    u = X.urls(spark, sf)
    hosts = A.host(F.col("clean"))
    allowed = F.when(F.length(hosts) % 2 == 0, F.array(hosts)).otherwise(F.array(F.lit("none.invalid")))
    private = F.when(F.startswith(hosts, F.lit("blog.")), F.array(hosts)).otherwise(F.array().cast("array<string>"))
    return u.select("page_id", "url", A.reject_reason(F.col("url"), allowed, private).alias("reject_reason"))


@query(f"WITH {X.URLS}, {_HOSTED} SELECT page_id, {_REASON} AS reject_reason FROM h")
def p11_url_admission(spark, sf):
    return _admitted(spark, sf).drop("url")


@query(f"WITH {X.URLS} SELECT page_id, regexp_replace(replace(url, 'user:pw@', ''), '[?#].*$', '') AS ref, sha256(url) AS ref_digest FROM urls")
def p12_redact(spark, sf):
    ref, digest = A.redact(F.col("url"))
    return X.urls(spark, sf).select("page_id", ref.alias("ref"), digest.alias("ref_digest"))


_IP = "concat(element_at(array('10', '127', '172', '192', '100', '169', '8', '224'), cast(event_id % 8 + 1 AS int)), '.', event_id % 256, '.', user_id % 256, '.', event_id % 200)"


@query("""WITH ip AS (SELECT event_id, event_id % 8 AS k, event_id % 256 AS b, user_id % 256 AS c FROM events) SELECT event_id, CASE WHEN k = 1 THEN 'loopback' WHEN k = 0 OR k = 2 AND b BETWEEN 16 AND 31 OR k = 3 AND b = 168 THEN 'private' WHEN k = 5 AND b = 254 OR k = 7 AND b = 0 AND c = 0 THEN 'link-local' WHEN k = 7 THEN 'multicast' WHEN k = 4 AND b BETWEEN 64 AND 127 THEN 'CGNAT' END AS strict,
 CASE WHEN k = 5 AND b = 254 OR k = 7 AND b = 0 AND c = 0 THEN 'link-local' WHEN k = 7 THEN 'multicast' WHEN k = 4 AND b BETWEEN 64 AND 127 THEN 'CGNAT' END AS relaxed FROM ip""")
def p13_ip_policy(spark, sf):
    e = X.table(spark, sf, "events").selectExpr("event_id", f"{_IP} AS addr")
    return e.select("event_id", A.ip_reason(F.col("addr")).alias("strict"), A.ip_reason(F.col("addr"), "relaxed").alias("relaxed"))


@query("""WITH ip AS (SELECT event_id, event_id % 8 AS k, event_id % 256 AS b, user_id % 256 AS c, CASE WHEN event_id % 2 = 0 THEN '::ffff:' || ['10', '127', '172', '192', '100', '169', '8', '224'][(event_id % 8 + 1)::INTEGER] || '.' || event_id % 256 || '.' || user_id % 256 || '.' || event_id % 200 ELSE ['fd00:ec2::', '2001:db8::', 'fe80::', 'ff02::', '::1:'][(event_id % 5 + 1)::INTEGER] || hex(event_id % 65536) END AS addr FROM events),
 r AS (SELECT *, CASE WHEN k % 2 = 0 THEN CASE WHEN k = 4 AND b BETWEEN 64 AND 127 THEN 'CGNAT' END WHEN addr LIKE 'fe80:%' OR addr LIKE 'ff02:%' THEN 'link-local' END AS any_policy, k = 0 OR k = 2 AND b BETWEEN 16 AND 31 OR addr LIKE 'fd00:%' AS private FROM ip)
SELECT event_id, addr, CASE WHEN private THEN 'private' ELSE any_policy END AS strict, CASE WHEN addr LIKE 'fd00:ec2:%' THEN 'metadata' ELSE any_policy END AS relaxed FROM r""")
def p13_ip6_policy(spark, sf):
    e = X.table(spark, sf, "events").selectExpr("event_id", f"if(event_id % 2 = 0, concat('::ffff:', {_IP}), concat(element_at(array('fd00:ec2::', '2001:db8::', 'fe80::', 'ff02::', '::1:'), cast(event_id % 5 + 1 AS int)), hex(event_id % 65536))) AS addr")
    return e.select("event_id", "addr", A.ip6_reason("strict")("addr").alias("strict"), A.ip6_reason("relaxed")("addr").alias("relaxed"))


_ERRORS = [
    ("", ""), ("context deadline exceeded", "timeout"), ("fetch: url scheme must be https", "rejected_url"), ("fetch: 10.0.0.1 is a private address", "denied_address"), ("too many redirects", "redirect"),
    ("body over max_bytes", "oversize"), ("Content-Type not allowed", "media_type"), ("server returned 404", "http_status"), ("connection reset", "other"),
]


@query(f"SELECT event_id, CASE event_id % 9 {' '.join(f'WHEN {i} THEN {chr(39)}{r}{chr(39)}' for i, (_, r) in enumerate(_ERRORS))} END AS reason FROM events")
def p14_fetch_reason(spark, sf):
    listed = F.array(*[F.lit(e) for e, _ in _ERRORS])
    return X.table(spark, sf, "events").select("event_id", A.fetch_reason(F.element_at(listed, (F.col("event_id") % 9 + 1).cast("int"))).alias("reason"))


@query("SELECT event_id, CASE WHEN event_id % 4 IN (2, 3) THEN 'media_type' WHEN event_id > 500 THEN 'oversize' END AS reason FROM events")
def p15_media_gate(spark, sf):
    e = X.table(spark, sf, "events").selectExpr("event_id", "element_at(array('Image/PNG; q=1', ' image/png ', 'text/html', null), cast(event_id % 4 + 1 AS int)) AS ct")
    return e.select("event_id", A.media_gate(F.col("ct"), F.col("event_id"), ["image/png", "image/jpeg"], 500).alias("reason"))


@query("""SELECT event_id, CASE WHEN event_id % 7 IN (0, 1) THEN replace(props, ' ', '') END AS metadata, CASE event_id % 7 WHEN 2 THEN 'not_object' WHEN 3 THEN 'not_object' WHEN 4 THEN 'invalid' WHEN 5 THEN 'invalid' END AS reason FROM events""")
def p16_metadata(spark, sf):
    e = X.table(spark, sf, "events").selectExpr("event_id", "CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN concat('  ', props, '\\n') WHEN 2 THEN '[1]' WHEN 3 THEN 'null' WHEN 4 THEN '{\"a\":' WHEN 5 THEN '{\"a\":1} oops' END AS m")
    return e.select("event_id", A.metadata("m").alias("x")).select("event_id", "x.metadata", "x.reason")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'interval' WHEN 1 THEN 'keyframe,interval' ELSE 'keyframe,mystery' END AS workflows, CASE WHEN event_id % 3 = 2 THEN 'mystery' ELSE '' END AS unknown FROM events")
def p17_workflows(spark, sf):
    e = X.table(spark, sf, "events").selectExpr("event_id", "CASE event_id % 3 WHEN 0 THEN cast(array() AS array<string>) WHEN 1 THEN array('keyframe', 'interval') ELSE array('keyframe', 'mystery') END AS w")
    chosen, unknown = A.workflows(F.col("w"), ["interval", "keyframe", "scene-detect"])
    return e.select("event_id", F.array_join(chosen, ",").alias("workflows"), F.array_join(unknown, ",").alias("unknown"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN (event_id % 15 - 3)::INTEGER END AS v FROM events) SELECT event_id, CASE WHEN v IS NULL THEN 8 WHEN v < 0 THEN -1 WHEN v > 8 THEN 8 ELSE v END AS threshold, v IS NULL OR v >= 0 AS enabled, v IS NULL OR v >= -1 AND v <= 8 AS accepted FROM e""")
def p18_dedup_override(spark, sf):
    t, on, ok = A.dedup_override(F.expr("if(event_id % 5 > 0, cast(event_id % 15 - 3 AS int), null)"), 8)
    return X.table(spark, sf, "events").select("event_id", t.alias("threshold"), on.alias("enabled"), ok.alias("accepted"))


@query(f"WITH {X.ATTEMPTS} SELECT job_id, attempt, CASE WHEN status = 200 THEN 'ok' WHEN status = 404 THEN 'terminal' ELSE 'retryable' END AS class, CASE WHEN status = 200 THEN NULL WHEN status IS NULL THEN 'retryable' ELSE status::VARCHAR END AS code, CASE WHEN retry_after >= 1 AND retry_after <= 120 THEN retry_after END AS wait FROM attempts")
def p20_status_class(spark, sf):
    s = F.col("status")
    return X.attempts(spark, sf).select("job_id", "attempt", A.status_class(s).alias("class"), A.error_code(s).alias("code"), A.retry_after(F.col("retry_after")).alias("wait"))


@query(f"""WITH {X.ATTEMPTS} SELECT job_id, attempt, (CASE WHEN status IN (200, 404) OR attempt >= 3 THEN 0 WHEN status IS NOT NULL AND retry_after BETWEEN 1 AND 120 THEN retry_after WHEN status = 429 THEN 2 * 2 ** (attempt - 1) ELSE 0.5 * 2 ** (attempt - 1) END)::DOUBLE AS wait FROM attempts""")
def p21_backoff(spark, sf):
    return X.attempts(spark, sf).select("job_id", "attempt", A.backoff(F.col("status"), F.col("retry_after"), F.col("attempt")).alias("wait"))


@query(f"WITH {X.FRAMES} SELECT asset_id, CASE WHEN bool_or(status = 'error') THEN coalesce(CASE WHEN any_value(conv_id) % 3 = 0 THEN 'decoder failed' END, string_agg(error, '; ' ORDER BY frame_idx)) ELSE CASE WHEN any_value(conv_id) % 4 = 0 THEN coalesce(CASE WHEN any_value(conv_id) % 3 = 0 THEN 'decoder failed' END, 'could not evaluate') END END AS error FROM frames GROUP BY asset_id")
def p22_error_text(spark, sf):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "status", "error"))), lambda x: F.struct(x["status"].alias("status"), x["error"].alias("error")))
    g = X.frames(spark, sf).groupBy("asset_id").agg(listed.alias("f"), F.max("conv_id").alias("c"))
    verdict = F.when(F.exists("f", lambda x: x["status"] == "error") | (F.col("c") % 4 == 0), "error").otherwise("allow")
    return g.select("asset_id", V.error_text(verdict, F.when(F.col("c") % 3 == 0, F.lit("decoder failed")), F.col("f")).alias("error"))


@query(f"WITH {X.JOBS} SELECT job_id, CASE WHEN event_id % 13 = 0 THEN 'retry' WHEN event_id % 17 = 0 THEN 'dead_letter' WHEN verdict = 'error' THEN 'dead_letter' ELSE 'ack' END AS disposition FROM jobs")
def p23_disposition(spark, sf):
    return X.jobs(spark, sf).select("job_id", V.disposition(F.expr("event_id % 13 <> 0"), F.expr("event_id % 17 <> 0"), F.col("verdict")).alias("disposition"))


@query(f"""WITH {X.SEVERITY}, {_resolved(DEFAULTS)}{VERDICT.replace("SELECT p.asset_id,", ", v AS (SELECT p.asset_id,", 1)}), j AS (SELECT v.*, split_part(asset_id, '-', 2)::BIGINT AS c FROM v) SELECT asset_id AS job_id, asset_id AS ref, 'video' AS media_type, CASE WHEN c % 13 = 0 OR verdict = 'error' THEN 'error' ELSE verdict END AS verdict, top_category, max_score, n_frames::INTEGER AS frames_scanned,
 (SELECT count(DISTINCT frame_idx) FROM fl WHERE fl.asset_id = j.asset_id AND status = 'ok' AND flagged)::INTEGER AS frames_flagged, 1000::BIGINT AS duration_ms FROM j WHERE c % 11 <> 0""")
def p24_job_records(spark, sf):
    c = F.split_part("job_id", F.lit("-"), F.lit(2)).cast("long")
    e = _envelopes(spark, sf).withColumn("disposition", F.when(c % 11 == 0, "retry").when((c % 13 == 0) | (F.col("result.overall.verdict") == "error"), "dead_letter").otherwise("ack"))
    return V.job_records(e).drop("finished_at")


_CONFIGS = "concat('c-', s_suppkey) AS config_id, element_at(array('off', 'Hybrid ', 'override', 'mystery', ''), cast(s_suppkey % 5 + 1 AS int)) AS mode"


@query("""WITH s AS (SELECT s_suppkey AS k, 'c-' || s_suppkey AS config_id, ['off', 'hybrid', 'override', 'mystery', ''][(s_suppkey % 5 + 1)::INTEGER] AS mode FROM supplier)
SELECT config_id, 'bound outside 0 to 1' AS rule, 'default' AS key FROM s WHERE k % 7 = 0 UNION ALL SELECT config_id, 'unknown mode', 'mystery' FROM s WHERE mode = 'mystery' UNION ALL SELECT config_id, 'labels while off', mode FROM s WHERE mode IN ('', 'off') AND (k % 3 = 0 OR k % 2 = 0)
UNION ALL SELECT config_id, 'override without labels', mode FROM s WHERE mode = 'override' AND k % 3 <> 0 UNION ALL SELECT config_id, 'armed and unarmed', 'gun' FROM s WHERE k % 6 = 0""")
def p25_threshold_violations(spark, sf):
    s = X.table(spark, sf, "supplier")
    base = s.selectExpr(_CONFIGS.split(", element")[0], "element" + _CONFIGS.split(", element")[1], "'base' AS kind", "'default' AS key", "if(s_suppkey % 7 = 0, 1.5D, 0.5D) AS flag_at", "0.8D AS block_at")
    label = s.filter("s_suppkey % 3 = 0").selectExpr(_CONFIGS.split(", element")[0], "element" + _CONFIGS.split(", element")[1], "'label' AS kind", "'Gun' AS key", "0.5D AS flag_at", "cast(null AS double) AS block_at")
    bare = s.filter("s_suppkey % 2 = 0").selectExpr(_CONFIGS.split(", element")[0], "element" + _CONFIGS.split(", element")[1], "'unarmed' AS kind", "'gun' AS key", "cast(null AS double) AS flag_at", "cast(null AS double) AS block_at")
    return T.violations(base.unionByName(label).unionByName(bare))


def _framed(spark, sf) -> DataFrame:
    joined = V.with_zero_frames(X.assets(spark, sf).select("asset_id", F.col("conv_id").alias("c")), X.frames(spark, sf).drop("conv_id"))
    return joined.groupBy("asset_id", "c").agg(F.count("frame_idx").alias("n_frames"))


@query(f"WITH {X.FRAMES}, {X.ASSETS} SELECT asset_id, 'error' AS status, 'no frames could be extracted' AS error, 0 AS n_categories FROM assets WHERE asset_id NOT IN (SELECT asset_id FROM frames)")
def p27_error_result(spark, sf):
    e = _framed(spark, sf).filter("n_frames = 0").select("asset_id", F.inline(V.error_frame()))
    return e.select("asset_id", "status", "error", F.size("categories").alias("n_categories"))


@query("SELECT concat('conv-', 1000000 + r_regionkey) AS job_id, CASE WHEN r_regionkey % 2 = 0 THEN 'skip' ELSE 'error' END AS outcome FROM region")
def p28_empty_skip(spark, sf):
    a = _framed(spark, sf).selectExpr("asset_id AS job_id", "if(c % 2 = 0, 'video', 'image') AS media_type", "n_frames")
    return V.empty_videos(a, True).select("job_id", "outcome")


# --- thresholds and joins ------------------------------------------------------------------------


@query(f"WITH {X.SEVERITY}, {_resolved(f'(VALUES {_values(S.DEFAULT_THRESHOLDS + LABELLED)}) th(key, flag_at, block_at)')} SELECT asset_id, frame_idx, cat_ord, flag_at, block_at FROM res")
def j1_thresholds(spark, sf):
    t = local(spark, S.DEFAULT_THRESHOLDS + LABELLED, T.SCHEMA)
    return T.resolve(N.severity(X.severity(spark, sf)), t).select("asset_id", "frame_idx", "cat_ord", "flag_at", "block_at")


@query("""WITH l AS (SELECT 'label:' || lower(p_name) AS key, (p_partkey % 10) / 10.0::DOUBLE AS flag_at, CASE WHEN p_partkey % 2 = 0 THEN 0.9::DOUBLE END AS block_at FROM part), b AS (SELECT * FROM (VALUES ('default', 0.5::DOUBLE, 0.8::DOUBLE), ('SEXUAL', 0.4, 0.7)) t(key, flag_at, block_at)), u AS (SELECT 'label:s-' || s_suppkey AS key, NULL::DOUBLE AS flag_at, NULL::DOUBLE AS block_at FROM supplier)
SELECT 'off' AS mode, * FROM b UNION ALL SELECT 'hybrid', * FROM b UNION ALL SELECT 'hybrid', * FROM l UNION ALL SELECT 'hybrid', * FROM u UNION ALL SELECT 'override', * FROM l UNION ALL SELECT 'override', * FROM u""")
def j2_merge_modes(spark, sf):
    labels = X.table(spark, sf, "part").selectExpr("p_name AS key", "p_partkey % 10 / 10.0D AS flag_at", "if(p_partkey % 2 = 0, 0.9D, null) AS block_at")
    bare = X.table(spark, sf, "supplier").selectExpr("concat('S-', s_suppkey) AS key")
    out = None
    for mode in ("off", "hybrid", "override"):
        t = T.merge(T.defaults(spark), labels, mode, bare).select(F.lit(mode).alias("mode"), "key", "flag_at", "block_at")
        out = t if out is None else out.unionByName(t)
    return out


@query(f"WITH {X.URLS}, {_HOSTED} SELECT page_id FROM h WHERE host IN (SELECT DISTINCT split_part(split_part(url, '://', 2), '/', 1) FROM pages WHERE page_id % 3 = 0)")
def j3_allow_hosts(spark, sf):
    hosts = X.table(spark, sf, "pages").filter("page_id % 3 = 0").select(A.host(F.col("url")).alias("host"))
    return A.permitted(X.urls(spark, sf), hosts).select("page_id")


@query("SELECT p_name || '-' || p_partkey AS label, p_partkey FROM part WHERE p_partkey % 3 <> 0")
def j4_uncovered_labels(spark, sf):
    p = X.table(spark, sf, "part")
    keys = p.filter("p_partkey % 3 = 0").selectExpr("concat('label:', lower(p_name), '-', p_partkey) AS key").distinct()
    return T.uncovered(p.selectExpr("concat(p_name, '-', p_partkey) AS label", "p_partkey"), keys)


@query(f"WITH {X.HASHES} SELECT a.asset_id, a.frame_idx AS a_idx, b.frame_idx AS b_idx, bit_count(xor(a.hash, b.hash))::INTEGER AS distance FROM hashes a JOIN hashes b ON a.asset_id = b.asset_id AND a.frame_idx < b.frame_idx WHERE bit_count(xor(a.hash, b.hash)) <= 26")
def j5_hamming_pairs(spark, sf):
    return FR.near_pairs(X.hashes(spark, sf), 26)


@query(f"WITH {X.FRAMES}, {X.ASSETS} SELECT a.asset_id, count(f.frame_idx) AS n_frames FROM assets a LEFT JOIN frames f USING (asset_id) GROUP BY 1")
def j6_zero_frames(spark, sf):
    return _framed(spark, sf).select("asset_id", "n_frames")


def _sev_lik(spark, sf):
    f = X.severity(spark, sf)
    a = _verdicts(N.severity(f), f, T.defaults(spark))
    g = X.likelihood(spark, sf)
    b = _verdicts(N.likelihood(g), g, T.defaults(spark)).filter(F.split_part("asset_id", F.lit("-"), F.lit(2)).cast("long") % 5 != 0)
    return a, b


def _sub(fixture: str, frames: str) -> str:
    return f"(WITH {fixture}, {_resolved(DEFAULTS)}{VERDICT})"


@query(f"SELECT coalesce(a.verdict, 'none') AS v1, coalesce(b.verdict, 'none') AS v2, count(*) AS n FROM {_sub(X.SEVERITY, '')} a FULL JOIN (SELECT * FROM {_sub(X.LIKELIHOOD, '')} WHERE split_part(asset_id, '-', 2)::BIGINT % 5 <> 0) b USING (asset_id) GROUP BY 1, 2")
def j7_model_agreement(spark, sf):
    a, b = _sev_lik(spark, sf)
    key = lambda d: d.select(F.col("asset_id").alias("key"), "verdict")
    return ops.agreement(key(a), key(b))


def _chains(spark, sf) -> DataFrame:
    none = spark.createDataFrame([], "chain_id long, seq long, entry_hash string")
    return audit.append(X.payload(spark, sf), none)


def audit_log(spark, sf) -> DataFrame:
    """The chains with some records forged, lost or cut off."""
    c = _chains(spark, sf).withColumn("_n", F.max("seq").over(Window.partitionBy("chain_id")))
    flip = (F.col("chain_id") % 5 == 1) & (F.col("seq") == 3)
    c = c.withColumn("payload", F.when(flip, F.map_concat(F.map_filter("payload", lambda k, v: k != "verdict"), F.create_map(F.lit("verdict"), F.lit("forged")))).otherwise(F.col("payload")))
    return c.filter("not (chain_id % 5 = 2 and seq = 2) and not (chain_id % 5 = 3 and seq > _n - 2)").drop("_n")


@query(f"""WITH {X.PAYLOAD}, n AS (SELECT chain_id, max(seq) AS n, max_by(entry_hash, seq) AS h FROM chain GROUP BY 1), t AS (SELECT chain_id, n, CASE chain_id % 5 WHEN 3 THEN n - 2 WHEN 2 THEN CASE WHEN n = 2 THEN 1 ELSE n END ELSE n END AS last FROM n)
SELECT chain_id, CASE WHEN chain_id % 7 = 6 THEN 'unanchored' WHEN last < n THEN 'truncated' WHEN chain_id % 7 = 5 THEN 'rewritten' ELSE 'ok' END AS status FROM t WHERE last > 0 OR chain_id % 7 <> 6""")
def j8_anchor_check(spark, sf):
    heads = audit.heads_of(_chains(spark, sf)).filter("chain_id % 7 <> 6").withColumn("entry_hash", F.when(F.col("chain_id") % 7 == 5, F.lit("0" * 64)).otherwise(F.col("entry_hash")))
    return audit.anchors(audit_log(spark, sf), heads)


@query(f"WITH {X.JOBS}, b AS (SELECT instance_id, max(finished_at) AS last FROM jobs GROUP BY 1), t AS (SELECT max(finished_at) AS now FROM jobs) SELECT job_id, instance_id, last AS last_beat FROM jobs LEFT JOIN b USING (instance_id), t WHERE (last IS NULL OR last < now - INTERVAL 60 SECOND)")
def j9_stranded_claims(spark, sf):
    j = X.jobs(spark, sf)
    beats = j.select("instance_id", F.col("finished_at").alias("at"))
    now = j.agg(F.max("finished_at")).first()[0]
    return ops.stranded(j.select("job_id", "instance_id"), beats, F.lit(now)).select("job_id", "instance_id", "last_beat")


@query(f"""WITH {X.JOBS} SELECT user_id AS chain_id, 'decision' AS kind, job_id FROM jobs WHERE event_id % 3 <> 0 AND event_id % 11 <> 0 UNION ALL SELECT user_id, 'event', job_id FROM jobs WHERE event_id % 11 = 0 UNION ALL SELECT user_id, 'event', NULL FROM jobs WHERE event_id % 13 = 0""")
def j10_audit_new(spark, sf):
    p = X.payload(spark, sf)
    stored = p.filter("ord % 3 = 0").select("chain_id", "payload")
    rows = p.select("chain_id", F.lit("decision").alias("kind"), (F.col("ord") * 4 + 1).alias("ord"), "payload")
    again = rows.filter("ord % 5 = 1").withColumn("ord", F.col("ord") + 1)
    seen = p.filter("ord % 11 = 0").select("chain_id", F.lit("event").alias("kind"), (F.col("ord") * 4).alias("ord"), "payload")
    plain = p.filter("ord % 13 = 0").select("chain_id", F.lit("event").alias("kind"), (F.col("ord") * 4 + 3).alias("ord"), F.create_map(F.lit("event"), F.lit("pause")).alias("payload"))
    return audit.unseen(stored, rows.unionByName(again).unionByName(seen).unionByName(plain)).select("chain_id", "kind", F.col("payload")["job_id"].alias("job_id"))


# --- aggregations --------------------------------------------------------------------------------


@query(f"WITH {X.SEVERITY}, {_resolved(DEFAULTS)}{VERDICT}")
def a1_verdict(spark, sf):
    f = X.severity(spark, sf)
    return _verdicts(N.severity(f), f, T.defaults(spark))


@query(f"WITH {X.LIKELIHOOD}, {_resolved(DEFAULTS)}{VERDICT}")
def a1_verdict_likelihood(spark, sf):
    f = X.likelihood(spark, sf)
    return _verdicts(N.likelihood(f), f, T.defaults(spark))


@query(f"WITH {X.HEADS}, {_resolved(f'(VALUES {_values(S.DEFAULT_THRESHOLDS)}) th(key, flag_at, block_at)')}{VERDICT}")
def a1_verdict_heads(spark, sf):
    f = X.heads(spark, sf)
    return _verdicts(N.heads(f, X.class_map(spark)), f, T.defaults(spark))


_POLICY_THRESHOLDS = [("label:dangerous", 0.6, 0.85), ("label:sexual", 0.6, 0.85), ("label:violence", 0.6, 0.85)]


@query(f"""WITH l AS (WITH {X.LOGPROB} SELECT * FROM rows), rows AS (SELECT * REPLACE (CASE WHEN k % 53 = 0 THEN 'error' ELSE status END AS status) FROM l), frames AS (SELECT DISTINCT asset_id, frame_idx, frame_ord, status FROM rows), {_resolved(f"(VALUES {_values(_POLICY_THRESHOLDS)}) th(key, flag_at, block_at)")}{VERDICT.replace("b.score AS max_score, b.score AS confidence", "round(b.score, 9) AS max_score, round(b.score, 9) AS confidence")}""")
def a1_verdict_logprob(spark, sf):
    """Thresholds of labels alone; a frame without an answer to one policy is an error."""
    rows = N.policies(X.logprob(spark, sf))
    frames = rows.groupBy("asset_id", "frame_ord").agg(F.max("status").alias("status"), F.min("status").alias("least"))
    frames = frames.withColumn("status", F.least("status", "least")).drop("least")  # error comes before ok
    v = _verdicts(rows, frames, local(spark, _POLICY_THRESHOLDS, T.SCHEMA))
    return v.withColumn("max_score", F.round("max_score", 9)).withColumn("confidence", F.round("confidence", 9))


@query(f"""WITH {X.JOBS}, c AS (SELECT count(*) FILTER (verdict = 'allow') AS allow, count(*) FILTER (verdict = 'flag') AS flag, count(*) FILTER (verdict = 'block') AS block, count(*) FILTER (verdict = 'error') AS error, count(*) FILTER (verdict = 'skip') AS skip, count(*) AS total FROM jobs)
SELECT *, allow + flag + block AS evaluated, coalesce((flag + block) / nullif(allow + flag + block, 0), 0) AS flag_rate, coalesce(block / nullif(allow + flag + block, 0), 0) AS block_rate, coalesce(error / nullif(total, 0), 0) AS error_rate FROM c""")
def a3_verdict_stats(spark, sf):
    return ops.verdict_stats(X.jobs(spark, sf))


@query(f"""WITH {X.JOBS}, v AS (SELECT * FROM jobs WHERE media_type = 'video'), h AS (SELECT * FROM v WHERE verdict IN ('flag', 'block'))
SELECT (SELECT sum(frames_scanned)::BIGINT FROM jobs) AS total_frames, (SELECT count(*) FROM v) AS video_jobs, (SELECT sum(frames_scanned)::BIGINT FROM v) AS video_frames, (SELECT sum(frames_scanned) / count(*) FROM v) AS avg_frames, (SELECT count(*) FROM h) AS flagged_videos, (SELECT sum(frames_flagged) / count(*) FROM h) AS avg_flagged_frames, (SELECT count(*) FROM h WHERE frames_flagged = 1) AS single_frame_videos""")
def a4_frame_stats(spark, sf):
    return ops.frame_stats(X.jobs(spark, sf))


@query(f"""WITH {X.JOBS} SELECT 'jobs' AS metric, verdict AS label, count(*) AS value FROM jobs GROUP BY 2 UNION ALL SELECT 'frames', media_type, sum(frames_scanned)::BIGINT FROM jobs GROUP BY 2 UNION ALL SELECT 'errors', adapter, count(*) FILTER (verdict = 'error') FROM jobs GROUP BY 2
 UNION ALL SELECT 'adapter_errors', adapter || ':' || CASE WHEN user_id % 2 = 0 THEN '429' ELSE 'retryable' END, count(*) FROM jobs WHERE verdict = 'error' GROUP BY 2 UNION ALL SELECT 'fetch_failures', 'timeout', count(*) FROM jobs WHERE verdict = 'error' AND user_id % 3 = 0 HAVING count(*) > 0 UNION ALL SELECT 'fetch_bytes', 'all', sum(user_id)::BIGINT FROM jobs WHERE media_type = 'image' UNION ALL SELECT 'sink_failures', adapter, count(*) FROM jobs WHERE verdict = 'skip' GROUP BY 2""")
def a5_counters(spark, sf):
    j = X.jobs(spark, sf).withColumn("error_code", F.expr("if(verdict = 'error', if(user_id % 2 = 0, '429', 'retryable'), null)")).withColumn("fetch_reason", A.fetch_reason(F.expr("if(verdict = 'error' and user_id % 3 = 0, 'context deadline exceeded', '')")))
    j = j.withColumn("fetch_reason", F.nullif("fetch_reason", F.lit(""))).withColumn("fetch_bytes", F.expr("if(media_type = 'image', user_id, null)")).withColumn("sink_failure", F.expr("if(verdict = 'skip', adapter, null)"))
    return ops.counters(j)


_EDGES = [1, 2, 4, 8, 16, 32, 64, 128]


@query(f"WITH {X.JOBS}, b AS (SELECT * FROM (VALUES {', '.join(f'({float(e)}::DOUBLE, {chr(39)}{float(e)}{chr(39)})' for e in _EDGES)}, ('inf'::DOUBLE, '+Inf')) t(edge, le)) SELECT media_type, le, count(*) FILTER (frames_scanned <= edge) AS n FROM jobs, b GROUP BY 1, 2")
def a6_histograms(spark, sf):
    return ops.histogram(X.jobs(spark, sf), "frames_scanned", _EDGES, "media_type")


@query(f"WITH {X.JOBS} SELECT adapter, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM jobs GROUP BY 1")
def a7_quantiles(spark, sf):
    return ops.quantiles(X.jobs(spark, sf), "value", "adapter")


_BUCKETS = " UNION ALL ".join([f"SELECT media_type, {float(e)}::DOUBLE AS le, count(*) FILTER (frames_scanned <= {float(e)}) AS n FROM jobs GROUP BY 1" for e in _EDGES] + ["SELECT media_type, 'inf'::DOUBLE, count(frames_scanned) FROM jobs GROUP BY 1"])


def _bucket_quantile(q: float) -> str:
    return f"""(SELECT CASE WHEN isinf(le) THEN e0 ELSE e0 + (le - e0) * coalesce(({q} * total - n0) / nullif(n - n0, 0), 1) END FROM c WHERE c.media_type = m.media_type AND n >= {q} * total ORDER BY le LIMIT 1)"""


@query(f"""WITH {X.JOBS}, b AS ({_BUCKETS}), c AS (SELECT *, coalesce(lag(n) OVER o, 0) AS n0, coalesce(lag(le) OVER o, 0) AS e0, max(n) OVER (PARTITION BY media_type) AS total FROM b WINDOW o AS (PARTITION BY media_type ORDER BY le))
SELECT media_type, {_bucket_quantile(0.5)} AS p50, {_bucket_quantile(0.95)} AS p95 FROM (SELECT DISTINCT media_type FROM c) m""")
def a7_bucket_quantiles(spark, sf):
    return ops.bucket_quantiles(ops.histogram(X.jobs(spark, sf), "frames_scanned", _EDGES, "media_type"), "media_type")


@query(None)
def a7_sketched_quantiles(spark, sf):
    return ops.sketched_quantiles(ops.sketches(X.jobs(spark, sf), "value", "adapter", "finished_at", 60), "adapter")


@query("""WITH t AS (SELECT 'adapter-' || p_partkey % 5 AS adapter, 'v' || p_partkey % 3 AS model_version, 'label:' || p_partkey AS key, CASE p_partkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE 'null' END AS f, CASE WHEN p_partkey % 2 = 0 THEN '0.25' ELSE 'null' END AS b FROM part)
SELECT adapter, model_version, sha256('{"adapter":"' || adapter || '","model_version":"' || model_version || '","thresholds":{' || string_agg('"' || key || '":{"flag_at":' || f || ',"block_at":' || b || '}', ',' ORDER BY key) || '}}') AS config_hash FROM t GROUP BY 1, 2""")
def a8_config_hash(spark, sf):
    p = X.table(spark, sf, "part").selectExpr("concat('adapter-', p_partkey % 5) AS adapter", "concat('v', p_partkey % 3) AS model_version", "concat('label:', p_partkey) AS key", "CASE p_partkey % 3 WHEN 0 THEN 0.0D WHEN 1 THEN 1.0D END AS flag_at", "if(p_partkey % 2 = 0, 0.25D, null) AS block_at")
    return T.config_hash(p)


@query(f"""WITH {X.FRAMES}, r AS (SELECT asset_id, conv_id, frame_idx, CASE WHEN k % 5 = 0 THEN NULL ELSE 100 - timestamp_sec END AS ts, CASE WHEN status = 'ok' AND conv_id % 10 > 0 THEN '{{"n":' || k || '}}' END AS raw FROM frames)
SELECT asset_id, CASE WHEN count(raw) = 0 THEN '' ELSE sha256('[' || string_agg(coalesce(raw, 'null'), ',' ORDER BY ts NULLS LAST, frame_idx) || ']') END AS raw_sha256 FROM r GROUP BY 1""")
def a9_raw_digest(spark, sf):
    f = X.frames(spark, sf).selectExpr("asset_id", "'video' AS media_type", "frame_ord", "if(k % 5 = 0, null, 100 - timestamp_sec) AS ts", "if(status = 'ok' and conv_id % 10 > 0, concat('{\"n\":', k, '}'), null) AS raw")
    return V.raw_digest(f)


@query(f"WITH {X.JOBS} SELECT CASE WHEN count(*) FILTER (verdict = 'error') > 0 THEN 2 WHEN count(*) FILTER (verdict <> 'allow') > 0 THEN 1 ELSE 0 END::INTEGER AS run_outcome FROM jobs")
def a10_run_outcome(spark, sf):
    return V.outcome(X.jobs(spark, sf).selectExpr("verdict", "if(verdict = 'error', 'dead_letter', 'ack') AS disposition"))


_STATES = "element_at(array('queued', 'claimed', 'retry', 'done', 'dead_letter'), cast((event_id + attempt) % 5 + 1 AS int))"


@query(f"""WITH {X.ATTEMPTS}, s AS (SELECT job_id, ['queued', 'claimed', 'retry', 'done', 'dead_letter'][((event_id + attempt) % 5 + 1)::INTEGER] AS state FROM attempts QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY "at" DESC, attempt DESC) = 1)
SELECT count(*) FILTER (state IN ('queued', 'retry')) AS pending, count(*) FILTER (state = 'claimed') AS processing, count(*) FILTER (state = 'dead_letter') AS dead, count(*) FILTER (state = 'done') AS done FROM s""")
def a11_depths(spark, sf):
    return ops.depths(X.attempts(spark, sf).selectExpr("job_id", f"{_STATES} AS state", "at", "attempt AS seq"))


@query(f"WITH {X.SEVERITY}, a AS (SELECT DISTINCT category, provider_label FROM rows), l AS (WITH {X.LIKELIHOOD} SELECT DISTINCT category, field AS label FROM rows) SELECT category, (SELECT string_agg(label, ',' ORDER BY label) FROM l WHERE l.category = c.category) AS likelihood, (SELECT string_agg(provider_label, ',' ORDER BY provider_label) FROM a WHERE a.category = c.category) AS severity FROM (SELECT category FROM a UNION SELECT category FROM l) c")
def a12_coverage(spark, sf):
    a = N.severity(X.severity(spark, sf)).select("category", F.lit("severity").alias("adapter"), F.col("provider_label").alias("label"))
    b = N.likelihood(X.likelihood(spark, sf)).select("category", F.lit("likelihood").alias("adapter"), F.split_part("provider_label", F.lit(":"), F.lit(1)).alias("label"))
    return ops.coverage(a.unionByName(b), ["likelihood", "severity"])


@query(f"""WITH {X.SEVERITY}, a AS (SELECT DISTINCT category, 'severity' AS adapter, provider_label AS label FROM rows), l AS (WITH {X.LIKELIHOOD} SELECT DISTINCT category, 'likelihood' AS adapter, field AS label FROM rows), h AS (WITH {X.HEADS} SELECT DISTINCT category, 'heads' AS adapter, lower(provider_label) AS label FROM rows), g AS (WITH {X.LOGPROB} SELECT DISTINCT category, 'logprob' AS adapter, provider_label AS label FROM rows),
 every AS (FROM a UNION ALL FROM l UNION ALL FROM h UNION ALL FROM g) SELECT category, {", ".join(f"string_agg(label, ',' ORDER BY label) FILTER (adapter = '{n}') AS {n}" for n in ("heads", "likelihood", "logprob", "severity"))} FROM every GROUP BY 1""")
def a12_coverage_adapters(spark, sf):
    """The labels of all four adapters."""
    of = lambda rows, name, label="provider_label": rows.select("category", F.lit(name).alias("adapter"), F.expr(label).alias("label"))
    rows = [
        of(N.heads(X.heads(spark, sf), X.class_map(spark)), "heads", "lower(provider_label)"), of(N.likelihood(X.likelihood(spark, sf)), "likelihood", "split_part(provider_label, ':', 1)"),
        of(N.policies(X.logprob(spark, sf)), "logprob"), of(N.severity(X.severity(spark, sf)), "severity"),
    ]
    return ops.coverage(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]), ["heads", "likelihood", "logprob", "severity"])


# --- windows -------------------------------------------------------------------------------------


@query(f"WITH {X.FRAMES} SELECT asset_id, frame_idx, n - 1 AS new_idx FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY wf_pos, wf_idx) AS n FROM frames) WHERE n <= 4")
def w1_budget(spark, sf):
    return FR.budget(X.frames(spark, sf), 4).select("asset_id", "frame_idx", "new_idx")


@query(f"WITH {X.FRAMES} SELECT asset_id, frame_idx, greatest(0, c - 3) AS frames_cut FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY wf_pos, wf_idx) AS n, count(*) OVER (PARTITION BY asset_id) AS c FROM frames) WHERE n <= 3")
def w2_scan_cap(spark, sf):
    return FR.capped(X.frames(spark, sf), 3).select("asset_id", "frame_idx", "frames_cut")


@query(f"WITH {X.FRAMES} SELECT asset_id, frame_idx, row_number() OVER (PARTITION BY asset_id ORDER BY CASE WHEN k % 5 = 0 THEN NULL ELSE 100 - timestamp_sec END NULLS LAST, frame_idx) - 1 AS frame_ord FROM frames")
def w3_frame_order(spark, sf):
    f = X.frames(spark, sf).withColumn("timestamp_sec", F.expr("if(k % 5 = 0, null, 100 - timestamp_sec)"))
    return FR.ordered(f).select("asset_id", "frame_idx", "frame_ord")


@query(f"WITH {X.JOBS} SELECT job_id, finished_at, verdict FROM jobs ORDER BY finished_at DESC, job_id DESC LIMIT 200")
def w4_recent(spark, sf):
    return ops.recent(X.jobs(spark, sf).select("job_id", "finished_at", "verdict"))


@query(f"WITH {X.PAYLOAD} SELECT chain_id, seq, prev_hash, entry_hash FROM chain")
def w5_chain(spark, sf):
    return _chains(spark, sf).select("chain_id", "seq", "prev_hash", "entry_hash")


@query(f"""WITH {X.PAYLOAD}, n AS (SELECT chain_id, max(seq) AS n FROM chain GROUP BY 1) SELECT chain_id, CASE WHEN chain_id % 5 IN (1, 2) AND n >= 3 THEN 3 END::BIGINT AS first_broken, CASE WHEN chain_id % 5 = 1 AND n >= 3 THEN 2 WHEN chain_id % 5 = 2 AND n >= 2 THEN 1 WHEN chain_id % 5 = 3 THEN n - 2 ELSE n END::BIGINT AS n_valid FROM n WHERE NOT (chain_id % 5 = 3 AND n <= 2)""")
def w6_verify(spark, sf):
    return audit.verify(audit_log(spark, sf))


@query(f"WITH {X.FRAMES} SELECT asset_id, frame_idx FROM frames WHERE timestamp_sec < 20 QUALIFY row_number() OVER (PARTITION BY asset_id, floor(timestamp_sec / 5) ORDER BY timestamp_sec, frame_idx) = 1")
def w7_interval(spark, sf):
    return FR.interval(X.frames(spark, sf), 5.0, 20.0).select("asset_id", "frame_idx")


@query(f"WITH {X.FRAMES} SELECT asset_id, frame_idx, 'scene' AS workflow FROM frames WHERE scene > 0.4 UNION ALL SELECT asset_id, frame_idx, 'keyframe' FROM frames WHERE is_keyframe")
def w8_scene_key(spark, sf):
    f = X.frames(spark, sf)
    pick = lambda d, n: d.select("asset_id", "frame_idx", F.lit(n).alias("workflow"))
    return pick(FR.scenes(f), "scene").unionByName(pick(FR.keyframes(f), "keyframe"))


@query(f"""WITH RECURSIVE {X.FRAMES}, s AS (SELECT asset_id, frame_idx, timestamp_sec, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp_sec, frame_idx) AS n FROM frames WHERE scene > 0.4),
 g AS (SELECT asset_id, frame_idx, n, timestamp_sec AS last, true AS kept, timestamp_sec FROM s WHERE n = 1 UNION ALL SELECT s.asset_id, s.frame_idx, s.n, CASE WHEN s.timestamp_sec - g.last >= 5 THEN s.timestamp_sec ELSE g.last END, s.timestamp_sec - g.last >= 5, s.timestamp_sec FROM g JOIN s ON s.asset_id = g.asset_id AND s.n = g.n + 1) SELECT asset_id, timestamp_sec, frame_idx FROM g WHERE kept""")
def w9_min_gap(spark, sf):
    return FR.min_gap(X.frames(spark, sf))


@query(f"""WITH {X.ATTEMPTS} SELECT job_id, disposition AS state FROM attempts QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY "at" DESC, attempt DESC) = 1""")
def w10_latest_state(spark, sf):
    return ops.latest(X.attempts(spark, sf).selectExpr("job_id", "disposition AS state", "at", "attempt"), "job_id", "state", "at", "attempt")


@query(f"WITH {X.JOBS} SELECT job_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS start_order FROM jobs")
def w11_fifo(spark, sf):
    return ops.arrival_order(X.jobs(spark, sf).selectExpr("job_id", "user_id AS source_partition", "event_id AS enqueue_seq")).select("job_id", "start_order")


@query(f"""WITH {X.ATTEMPTS}, t AS (SELECT max(finished_at) - INTERVAL 10 DAY AS now FROM jobs) SELECT job_id, attempt, "at" + INTERVAL 30 SECOND AS ready_at FROM attempts, t WHERE disposition = 'retry' AND "at" + INTERVAL 30 SECOND <= now ORDER BY ready_at, job_id, attempt LIMIT 100""")
def w12_due_retries(spark, sf):
    r = X.attempts(spark, sf).filter("disposition = 'retry'").selectExpr("job_id", "attempt", "at + interval 30 seconds AS ready_at")
    now = X.jobs(spark, sf).agg(F.expr("max(finished_at) - interval 10 days")).first()[0]
    return ops.due(r, F.lit(now))


@query(f"""WITH {X.JOBS}, o AS (SELECT adapter, finished_at AS "at", event_id AS seq, verdict <> 'error' AS ok FROM jobs), i AS (SELECT *, row_number() OVER (PARTITION BY adapter ORDER BY "at", seq) - row_number() OVER (PARTITION BY adapter, ok ORDER BY "at", seq) AS g FROM o),
 r AS (SELECT adapter, ok, g, count(*) AS n FROM i GROUP BY 1, 2, 3), w AS (SELECT a.adapter, a.seq, count(*) AS n, count(*) FILTER (NOT b.ok) AS e FROM o a JOIN o b ON a.adapter = b.adapter AND b."at" <= a."at" AND b."at" > a."at" - INTERVAL 7200 SECOND GROUP BY 1, 2)
SELECT adapter, coalesce(max(n) FILTER (NOT ok), 0) AS longest_run, (SELECT max(e / n) FROM w WHERE w.adapter = r.adapter AND w.n >= 5) AS worst_rate FROM r GROUP BY 1""")
def w13_outage_scan(spark, sf):
    return ops.outages(X.jobs(spark, sf).selectExpr("adapter", "finished_at AS at", "event_id AS seq", "verdict <> 'error' AS ok"), 7200, 5)


# --- de-duplication ------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {X.HASHES}, o AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY frame_idx) AS n FROM hashes),
 g AS (SELECT asset_id, frame_idx, hash, n, true AS kept, CASE WHEN hash IS NULL THEN []::BIGINT[] ELSE [hash] END AS seen FROM o WHERE n = 1 UNION ALL
 SELECT o.asset_id, o.frame_idx, o.hash, o.n, o.hash IS NULL OR len(list_filter(g.seen, lambda x: bit_count(xor(x, o.hash)) <= 26)) = 0, CASE WHEN o.hash IS NOT NULL AND len(list_filter(g.seen, lambda x: bit_count(xor(x, o.hash)) <= 26)) = 0 THEN list_append(g.seen, o.hash) ELSE g.seen END FROM g JOIN o ON o.asset_id = g.asset_id AND o.n = g.n + 1)
SELECT asset_id, frame_idx, hash, row_number() OVER (PARTITION BY asset_id ORDER BY frame_idx) - 1 AS new_idx FROM g WHERE kept""")
def d2_dedup(spark, sf):
    return FR.dedup(X.hashes(spark, sf), 26)


@query(f"""WITH {X.PICTURES} SELECT vec_id // 10 AS asset_id, vec_id % 10 AS frame_idx, CASE WHEN coalesce(whole, false) THEN 16 ELSE -1 END AS height, CASE WHEN coalesce(whole, false) THEN 18 ELSE -1 END AS width, CASE WHEN coalesce(whole, false) THEN n ELSE -1 END AS channels, CASE WHEN coalesce(whole, false) THEN sha256(unhex({X.PICTURE_BYTES})) END AS pixels_sha256 FROM pictures""")
def s3_images(spark, sf):
    i = X.pictures(spark, sf).withColumn("image", png.decoded(F.col("content")))
    return i.select("asset_id", "frame_idx", F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.when(F.col("image.height") > 0, F.sha2("image.data", 256)).alias("pixels_sha256"))


@query(f"""WITH {X.PICTURE_CELLS}, bits AS (SELECT vec_id, 8 * y + x AS k, m < lead(m) OVER (PARTITION BY vec_id, y ORDER BY x) AS b FROM cells), h AS (SELECT vec_id, sum(CASE WHEN NOT b THEN 0 WHEN k = 0 THEN -9223372036854775808 ELSE 1::BIGINT << (63 - k)::INTEGER END)::BIGINT AS hash FROM bits WHERE b IS NOT NULL GROUP BY 1)
SELECT vec_id // 10 AS asset_id, vec_id % 10 AS frame_idx, hash FROM pictures LEFT JOIN h USING (vec_id)""")
def d1_dhash(spark, sf):
    i = X.pictures(spark, sf).withColumn("image", png.decoded(F.col("content")))
    return FR.hashed(i).select("asset_id", "frame_idx", "hash")


# --- batch twins of streams ----------------------------------------------------------------------


@query(f"""WITH RECURSIVE {X.REDELIVERED}, o AS (SELECT job_id, finished_at, row_number() OVER (PARTITION BY job_id ORDER BY finished_at) AS n FROM redelivered),
 g AS (SELECT job_id, finished_at, n, finished_at AS claim, true AS passes FROM o WHERE n = 1 UNION ALL SELECT o.job_id, o.finished_at, o.n, CASE WHEN o.finished_at > g.claim + INTERVAL 1 HOUR THEN o.finished_at ELSE g.claim END, o.finished_at > g.claim + INTERVAL 1 HOUR FROM g JOIN o ON o.job_id = g.job_id AND o.n = g.n + 1)
SELECT job_id, finished_at FROM g WHERE passes""")
def t2_redelivery(spark, sf):
    return B.claims(X.redelivered(spark, sf).select("job_id", "finished_at"))


@query(f"""WITH RECURSIVE {X.JOBS}, o AS (SELECT adapter, finished_at AS "at", event_id AS seq, verdict <> 'error' AS ok, epoch_us(finished_at) AS t, row_number() OVER (PARTITION BY adapter ORDER BY finished_at, event_id) AS n FROM jobs),
 g AS (SELECT DISTINCT adapter, 0::BIGINT AS n, NULL::TIMESTAMP AS "at", NULL::BIGINT AS seq, 0 AS bad, 0 AS good, false AS tripped, []::STRUCT(t BIGINT, ok BOOLEAN)[] AS kept FROM o UNION ALL
 SELECT adapter, n, "at", seq, bad, good, CASE WHEN ok THEN tripped AND good < 2 ELSE tripped OR bad >= 4 OR len(k) >= 10 AND len(list_filter(k, lambda x: NOT x.ok)) * 100 / len(k) >= 50 END, CASE WHEN ok AND tripped AND good >= 2 THEN [] ELSE k END
 FROM (SELECT o.adapter, o.n, o."at", o.seq, o.ok, CASE WHEN o.ok THEN 0 ELSE g.bad + 1 END AS bad, CASE WHEN o.ok THEN g.good + 1 ELSE 0 END AS good, g.tripped, list_append(list_filter(g.kept, lambda x: x.t > o.t - 60000000), {{'t': o.t, 'ok': o.ok}}) AS k FROM g JOIN o ON o.adapter = g.adapter AND o.n = g.n + 1))
SELECT adapter, "at", seq, tripped FROM g WHERE n > 0""")
def t3_backpressure(spark, sf):
    return B.backpressure(X.jobs(spark, sf).selectExpr("adapter", "finished_at AS at", "event_id AS seq", "verdict <> 'error' AS ok"), n=4, m=2)


@query(f"WITH {X.JOBS} SELECT time_bucket(INTERVAL 1 MINUTE, finished_at) AS window_start, sum(frames_scanned) / 60.0::DOUBLE AS frames_per_second, count(*) FILTER (verdict = 'error') / 60.0::DOUBLE AS errors_per_second FROM jobs GROUP BY 1")
def t4_frame_rates(spark, sf):
    return B.frame_rates(X.jobs(spark, sf))


@query(f"""WITH {X.JOBS}, w AS (SELECT time_bucket(INTERVAL 1 MINUTE, finished_at) - INTERVAL 1 MINUTE * unnest(range(5)) AS window_start, media_type, frames_scanned FROM jobs)
SELECT window_start, media_type, count(*) AS jobs, avg(frames_scanned) AS mean_frames, max(frames_scanned)::BIGINT AS most_frames FROM w GROUP BY 1, 2""")
def t4_frames_per_job(spark, sf):
    return B.frames_per_job(X.jobs(spark, sf))


@query(f"WITH {X.JOBS} SELECT time_bucket(INTERVAL 1 MINUTE, finished_at) AS window_start, verdict, count(*) / 60.0::DOUBLE AS per_second FROM jobs GROUP BY 1, 2")
def t4_rates(spark, sf):
    return B.rates(X.jobs(spark, sf))


@query(f"""WITH {X.ATTEMPTS}, s AS (SELECT *, CASE WHEN disposition = 'ack' THEN 'done' WHEN disposition = 'retry' AND attempt <= 3 THEN 'retry' ELSE 'dead' END AS state FROM attempts), e AS (SELECT job_id, min(attempt) AS stop FROM s WHERE state <> 'retry' GROUP BY 1)
SELECT job_id, attempt, state, CASE WHEN disposition = 'retry' THEN attempt ELSE attempt - 1 END AS retries, CASE WHEN state = 'retry' THEN "at" + to_seconds(30 * attempt) END AS ready_at FROM s LEFT JOIN e USING (job_id) WHERE stop IS NULL OR attempt <= stop""")
def t5_retry_ledger(spark, sf):
    return B.ledger(X.attempts(spark, sf))


@query(f"""WITH {X.JOBS}, t AS (SELECT max(finished_at) AS now FROM jobs), b AS (SELECT instance_id, finished_at AS "at", CASE WHEN finished_at >= lag(finished_at) OVER w + INTERVAL 3600 SECOND OR lag(finished_at) OVER w IS NULL THEN 1 ELSE 0 END AS head FROM jobs WINDOW w AS (PARTITION BY instance_id ORDER BY finished_at)),
 g AS (SELECT *, sum(head) OVER (PARTITION BY instance_id ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS g FROM b) SELECT instance_id, min("at") AS session_start, max("at") + INTERVAL 3600 SECOND AS session_end, count(*) AS beats, max("at") + INTERVAL 3600 SECOND < (SELECT now FROM t) AS stale FROM g GROUP BY instance_id, g""")
def t6_liveness(spark, sf):
    j = X.jobs(spark, sf)
    now = j.agg(F.max("finished_at")).first()[0]
    return B.sessions(j.select("instance_id", F.col("finished_at").alias("at")), F.lit(now), 3600)


@query(f"""WITH {X.URLS}, {_HOSTED}, r AS (SELECT page_id, page_id % 4 AS part, CASE WHEN {_REASON} IS NOT NULL THEN 'bad_request:' || {_REASON} END AS r FROM h), n AS (SELECT *, count(*) FILTER (r IS NULL) OVER (PARTITION BY part ORDER BY page_id) AS n FROM r)
SELECT concat('job-', page_id) AS job_id, coalesce(r, CASE WHEN n > 10 THEN 'queue_full' END) IS NULL AS accepted, coalesce(r, CASE WHEN n > 10 THEN 'queue_full' END) AS reason FROM n""")
def t7_intake_gate(spark, sf):
    control = local(spark, [(False, False, 3, 10)], "tripped boolean, paused boolean, dead_letters int, free int")
    j = _admitted(spark, sf).selectExpr("concat('job-', page_id) AS job_id", "page_id % 4 AS source_partition", "page_id AS enqueue_seq", "reject_reason AS bad_request")
    return B.gate(j, control)


@query(f"""WITH RECURSIVE {X.INTAKE}, c AS (SELECT *, coalesce(last_value(tripped IGNORE NULLS) OVER w, false) AS tr, coalesce(last_value(paused IGNORE NULLS) OVER w, false) AS pa, sum(letters) OVER w AS le FROM intake WINDOW w AS (PARTITION BY queue ORDER BY "at", kind, seq ROWS UNBOUNDED PRECEDING)),
 r AS (SELECT queue, job_id, kind, CASE WHEN tr THEN 'backpressure' WHEN pa THEN 'paused' WHEN bad IS NOT NULL THEN 'bad_request:' || bad WHEN le >= 4 THEN 'dead_letters_full' END AS r, row_number() OVER (PARTITION BY queue ORDER BY "at", kind, seq) AS n FROM c WHERE kind > 0),
 g AS (SELECT DISTINCT queue, NULL::VARCHAR AS job_id, 1 AS kind, NULL::VARCHAR AS reason, 0::BIGINT AS n, 0 AS waiting FROM r UNION ALL SELECT r.queue, r.job_id, r.kind, CASE WHEN r.kind = 2 THEN coalesce(r.r, CASE WHEN g.waiting >= 10 THEN 'queue_full' END) END, r.n, CASE WHEN r.kind = 1 THEN greatest(0, g.waiting - 1) WHEN r.r IS NULL AND g.waiting < 10 THEN g.waiting + 1 ELSE g.waiting END FROM g JOIN r ON r.queue = g.queue AND r.n = g.n + 1)
SELECT queue, job_id, reason IS NULL AS accepted, reason, waiting::BIGINT AS waiting FROM g WHERE kind = 2""")
def t7_intake_over_time(spark, sf):
    return I.intake(X.intake(spark, sf), cap=4, buffer=10)


_KEY = b"key of the demonstration"
_PADS = {n: bytes(k ^ x for k in _KEY.ljust(64, b"\0")).hex() for n, x in (("inner", 0x36), ("outer", 0x5C))}
_HMAC = f"sha256(unhex('{_PADS['outer']}') || unhex(sha256(unhex('{_PADS['inner']}') || encode(entry_hash))))"


@query(f"""WITH {X.PAYLOAD} SELECT chain_id, seq, {_HMAC} AS signature FROM chain""")
def f5_signed(spark, sf):
    return audit.signed(_chains(spark, sf), _KEY).select("chain_id", "seq", "signature")


@query(f"""WITH {X.PAYLOAD} SELECT chain_id, seq FROM chain WHERE seq % 5 IN (1, 2)""")
def f5_bad_signatures(spark, sf):
    """Every fifth signature is missing and every fifth is another record's."""
    rows = audit.signed(_chains(spark, sf), _KEY)
    forged = F.when(F.col("seq") % 5 == 1, None).when(F.col("seq") % 5 == 2, F.sha2("signature", 256)).otherwise(F.col("signature"))
    return audit.bad_signatures(rows.withColumn("signature", forged), _KEY).select("chain_id", "seq")


@query(f"""WITH {X.FRAMES} SELECT asset_id, frame_idx, CASE WHEN asset_id IN ('conv-0', 'conv-3', 'conv-6') THEN 'error' ELSE 'ok' END AS status, CASE WHEN asset_id IN ('conv-0', 'conv-3', 'conv-6') THEN 'no answer for ' || asset_id END AS error, CASE WHEN asset_id NOT IN ('conv-0', 'conv-3', 'conv-6') THEN '{{"categoriesAnalysis":[]}}' END AS response FROM frames""")
def f1_score_frames(spark, sf):
    """Fake answers over all frames; three assets fail by themselves."""
    f = X.frames(spark, sf).selectExpr("asset_id", "frame_idx", "cast(asset_id AS binary) AS content", "length(asset_id) AS n_bytes")
    return scoring.score_frames(f, scoring.create("fake", response='{"categoriesAnalysis":[]}', failing=("conv-0", "conv-3", "conv-6")))
