"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.local import local
from . import decontaminate, html, language_model, merkle, mixing, near_duplicates, neighbours, periodic_runs, secrets, suffix_dedup, surrogates, toxicity, url_filters
from .storage import table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.removed_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a demonstration key; a real run sets its own
    key = spark.conf.get("modsieve.surrogates.key", "demonstration")
    return surrogates.replaced(table(spark, sf_dir, "documents"), key).select("doc_id", "text", "n_entities")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text), a tenth of the rows (by checksum of the id) with words that repeat from some place on."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    h = F.crc32(doc_id.cast("string"))
    g, words = F.floor(h / 10), F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    some = docs.select(doc_id.alias("doc_id"), text.alias("text"), g.alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w")
    a = (F.col("g") % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    return some.select("doc_id", F.when(n > 0, F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), a), tail), F.lit(1), n), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_periodic_tails(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("s"), (-r.period).alias("p"))))
    found = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.p")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("string")
    tampered = F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 == 0
    found = F.when(tampered, url_filters.lowered(text)).otherwise(text)
    return merkle.manifest(table(spark, sf_dir, "documents"), found)


#: The rules of the filter query (verdict, host, path).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(table(spark, sf_dir, "pages"), local(spark, URL_RULES, "verdict string, host string, path string"))


def queries() -> dict:
    found = (op1_html, op2_suffix_array, op3_toxicity, op4_surrogates, op5_minhash, op6_neighbours, op7_language_model, op8_secrets, op9_mixing, op10_decontaminate, op11_periodic_runs, op12_merkle, op13_url_filters)
    return {f.__name__: f for f in found}


#: All 50-byte strings as hexadecimal text, cut out of blocks of 500 bytes, and the union of the
#: places whose string a smaller doc_id has.
SUFFIX_ARRAY_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, k, substr(h, 1000 * k + 1, 1098) AS p FROM (SELECT doc_id, h, unnest(range(0, length(h) // 1000 + 1)) AS k FROM d)),
w AS (SELECT doc_id, 500 * k + j AS i, substr(p, 2 * j + 1, 100) AS s FROM (SELECT doc_id, k, p, unnest(range(0, least(500, greatest(0, length(p) // 2 - 49)))) AS j FROM b)),
m AS (SELECT s, min(doc_id) AS o FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, i FROM w JOIN m USING (s) WHERE o < doc_id),
e AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS head FROM r),
g AS (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM e),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, k),
cut AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y, b FROM span),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - y)::BIGINT AS n_removed, max(b) AS last, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY y) AS k FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

#: The exponent by plain halving, the same 32 places; budgets, blocks and passes by window sums.
MIXING_SQL = r"""WITH RECURSIVE t AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0)::BIGINT AS n_tokens, coalesce('s:' || source, 'null') AS s, ('0x' || substr(md5(concat_ws(':', 'mix', doc_id)), 1, 15))::BIGINT AS h FROM documents),
src AS (SELECT s, sum(n_tokens)::BIGINT AS tokens FROM t GROUP BY s HAVING sum(n_tokens) > 0),
f AS (SELECT sum(tokens)::DOUBLE AS total, 0.97::DOUBLE * ln(count(*)) AS target FROM src),
p AS (SELECT s, tokens, tokens / total AS p, target, total FROM src, f),
bis AS (SELECT 0 AS step, 0::DOUBLE AS lo, 1::DOUBLE AS hi, 0::DOUBLE AS lo2, 1::DOUBLE AS hi2 UNION ALL
 SELECT step + 1, CASE WHEN spread THEN (lo + hi) / 2 ELSE lo END, CASE WHEN spread THEN hi ELSE (lo + hi) / 2 END, CASE WHEN over THEN (lo2 + hi2) / 2 ELSE lo2 END, CASE WHEN over THEN hi2 ELSE (lo2 + hi2) / 2 END
 FROM (SELECT step, lo, hi, lo2, hi2, ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) >= any_value(target) AS spread, max(pow(p, (lo2 + hi2) / 2 - 1)) / sum(pow(p, (lo2 + hi2) / 2)) > 4 AS over FROM bis, p WHERE step < 32 GROUP BY step, lo, hi, lo2, hi2)),
e AS (SELECT greatest(CASE WHEN (SELECT -sum(p * ln(p)) >= any_value(target) FROM p) THEN 1 ELSE lo END, CASE WHEN (SELECT max(1 / p) / count(*) <= 4 FROM p) THEN 0 ELSE hi2 END) AS a FROM bis WHERE step = 32),
z AS (SELECT sum(pow(p, a)) AS z FROM p, e),
b AS (SELECT s, tokens, round(pow(p, a) / z * total)::BIGINT AS budget, greatest(1, ceil(tokens / 200000))::BIGINT AS n FROM p, e, z),
placed AS (SELECT t.*, tokens, budget, h % n AS block FROM t JOIN b USING (s)),
blocks AS (SELECT s, block, sum(n_tokens)::BIGINT AS bt, any_value(tokens) AS tokens, any_value(budget) AS budget FROM placed GROUP BY s, block),
passes AS (SELECT *, unnest(range(0, (budget - 1) // tokens + 1)) AS pass FROM blocks WHERE budget > 0),
drawn AS (SELECT s, block, pass, row_number() OVER o - 1 AS block_pos, budget, coalesce(sum(bt) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + pass * tokens AS before FROM passes WINDOW o AS (PARTITION BY s, pass ORDER BY md5(concat_ws(':', 'mix', s, pass, block)), block)),
ranked AS (SELECT *, row_number() OVER o - 1 AS doc_pos, (sum(n_tokens) OVER (o ROWS UNBOUNDED PRECEDING))::BIGINT - n_tokens AS done FROM placed WINDOW o AS (PARTITION BY s, block ORDER BY h, doc_id, n_tokens))
SELECT doc_id, source, n_tokens, pass, r.block, block_pos::INTEGER AS block_pos, doc_pos::INTEGER AS doc_pos, before / d.budget AS at FROM ranked r JOIN drawn d USING (s, block) WHERE before < d.budget AND done < d.budget - before"""


#: Matches of every kind with their places, from the pieces between them; weak ones met by a range join.
SECRETS_SQL = r"""WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS t FROM documents),
p(kind, rank, pat, g) AS (VALUES ('assign', 0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), ('access', 1, '(AKIA[A-Z0-9]+)', 1), ('hex', 2, '([0-9a-f]+)', 1),
 ('account', 3, '\b([Aa][Cc][Cc][Ee][Ss][Ss]_?[Kk][Ee][Yy]_?[Ii][Dd]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Uu][Ss][Ee][Rr]_?[Nn][Aa][Mm][Ee]|[Uu][Ss][Ee][Rr]|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9_.@+-]{3,64})', 2), ('run', 4, '([A-Za-z0-9+/=_-]+)', 1), ('endpoint', 5, '\b([a-z][a-z0-9+.-]{1,15}://[^\t-\r "''<>]+)', 1)),
m AS (SELECT u, kind, rank, regexp_extract_all(t, pat) AS ms, regexp_extract_all(t, pat, g) AS gs, string_split_regex(t, pat) AS gaps FROM d, p),
s AS (SELECT u, kind, rank, unnest(ms) AS s, unnest(gs) AS v, unnest(gaps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS k FROM m WHERE len(ms) > 0),
pos AS (SELECT u, kind, rank, s, v, sum(length(gap) + length(s)) OVER (PARTITION BY u, kind ORDER BY k ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM s),
f AS (SELECT u, kind, rank, s, e - length(s) AS b, e FROM pos WHERE CASE kind WHEN 'assign' THEN length(v) >= 8 WHEN 'access' THEN length(s) >= 16 WHEN 'hex' THEN length(s) >= 32 WHEN 'run' THEN regexp_full_match(s, '[A-Za-z0-9+/_-]{20,}={0,2}') AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[a-z]') AND regexp_matches(s, '[A-Z]') ELSE true END),
base AS (SELECT * FROM f WHERE rank < 3),
clear AS (SELECT * FROM f WHERE rank > 2 AND NOT EXISTS (SELECT 1 FROM base WHERE base.u = f.u AND base.b < f.e AND f.b < base.e)),
token AS (SELECT u, 'token' AS kind, rank, s, b, e FROM clear c WHERE kind = 'run' AND NOT EXISTS (SELECT 1 FROM f WHERE f.u = c.u AND f.kind = 'endpoint' AND f.b < c.e AND c.b < f.e) AND NOT EXISTS (SELECT 1 FROM clear a WHERE a.u = c.u AND a.kind = 'account' AND a.b < c.e AND c.b < a.e)
 AND (SELECT -sum(n / length(c.s) * log2(n / length(c.s))) FROM (SELECT x, count(*) AS n FROM (SELECT unnest(string_split(c.s, '')) AS x) GROUP BY x)) >= 3.5),
part AS (SELECT u, kind, rank, b, e FROM base UNION ALL SELECT u, kind, rank, b, e FROM clear WHERE kind <> 'run' UNION ALL SELECT u, kind, rank, b, e FROM token),
met AS (SELECT w.u, w.kind, w.rank, w.b, w.e, bool_or(o.kind IN ('access', 'account')) AS ident, bool_or(o.kind IN ('assign', 'hex', 'token')) AS secret FROM part w JOIN part o ON w.u = o.u AND w.rank > 2 AND o.kind <> 'endpoint' AND o.b - w.e <= 400 AND w.b - o.e <= 400 GROUP BY ALL),
found AS (SELECT u, kind, rank, b, e FROM base UNION ALL SELECT u, kind, rank, b, e FROM met WHERE CASE kind WHEN 'token' THEN ident WHEN 'account' THEN secret ELSE ident AND secret END),
r AS (SELECT u, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS spans FROM found GROUP BY u)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r USING (u)"""


#: A run of four periods holds four multiples of its period with one word; periods that have such
#: places are compared word by word, and equal stretches keep their smallest period.
PERIODIC_RUNS_SQL = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)) END AS h FROM documents),
c AS MATERIALIZED (SELECT u, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS changed, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM d),
o AS (SELECT u, unnest(range(len(w))) AS i, unnest(w) AS t FROM c),
q AS (SELECT u, n, changed, a, 1 + (n - a) // (3 + g % 8) AS p FROM c),
m AS (SELECT o.u, o.i, CASE WHEN changed AND o.i >= a THEN a + (o.i - a) % p ELSE o.i END AS src, n FROM o JOIN q USING (u)),
t AS MATERIALIZED (SELECT m.u, m.i, o.t FROM m JOIN o ON o.u = m.u AND o.i = m.src),
k AS (SELECT u, p, unnest(range(0, n - 3 * p, p)) AS i FROM (SELECT u, n, unnest(range(1, n // 4 + 1)) AS p FROM c)),
k1 AS MATERIALIZED (SELECT k.u, p, k.i, t FROM k JOIN t ON t.u = k.u AND t.i = k.i),
k2 AS MATERIALIZED (SELECT k.u, p, k.i, k.t FROM k1 k JOIN t ON t.u = k.u AND t.i = k.i + p AND t.t = k.t),
k3 AS MATERIALIZED (SELECT k.u, p, k.i, k.t FROM k2 k JOIN t ON t.u = k.u AND t.i = k.i + 2 * p AND t.t = k.t),
cand AS MATERIALIZED (SELECT DISTINCT k.u, p FROM k3 k JOIN t ON t.u = k.u AND t.i = k.i + 3 * p AND t.t = k.t),
x AS MATERIALIZED (SELECT t.u, p, i, t FROM cand JOIN t USING (u)),
e AS (SELECT x.u, x.p, x.i FROM x JOIN t ON t.u = x.u AND t.i = x.i + x.p AND t.t = x.t),
s AS (SELECT u, p, min(i) AS b, count(*) + p AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY u, p ORDER BY i) AS island FROM e) GROUP BY u, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
r AS (SELECT u, b, l, min(p) AS p FROM s GROUP BY u, b, l),
f AS (SELECT u, count(*) AS n_runs, string_agg(b || ',' || l || ',' || p || chr(10), '' ORDER BY b, p) AS runs, min(struct_pack(l := -l, b := b, p := p)) AS best FROM r GROUP BY u),
gone AS (SELECT DISTINCT u, unnest(range(b + p, b + l)) AS i FROM r),
kept AS (SELECT t.u, string_agg(t.t, ' ' ORDER BY t.i) AS k FROM t LEFT JOIN gone USING (u, i) WHERE gone.i IS NULL GROUP BY t.u)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.b AS start, -best.l AS length, best.p AS period, 1000 * -best.l // best.p AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256
FROM c LEFT JOIN f USING (u) LEFT JOIN kept USING (u)"""


#: The checksum bit by bit; a level a step of recursion, up the languages' trees, then over the languages;
#: folding with the siblings of each level, a step of recursion each.
MERKLE_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, lang, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
 coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
 xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)) AS crc FROM documents),
l AS (SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, CASE WHEN doc_id IS NOT NULL AND crc % 3 = 0 THEN sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) END AS other FROM d),
n AS MATERIALIZED (SELECT *, row_number() OVER () AS u, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
up AS (SELECT 0 AS lv, lang, pos, leaf AS h FROM n UNION ALL SELECT lv + 1, lang, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS c FROM up) WHERE c > 1 GROUP BY lv, lang, pos // 8),
sub AS (SELECT lang, arg_max(h, lv) AS h, max(lv) AS top FROM up GROUP BY lang),
f AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k FROM sub),
fup AS (SELECT 0 AS lv, k AS pos, h FROM f UNION ALL SELECT lv + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS c FROM fup) WHERE c > 1 GROUP BY lv, pos // 8),
root AS (SELECT arg_max(h, lv) AS root, max(lv) AS top FROM fup),
side AS (SELECT a.lang, a.lv, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r FROM up a JOIN up b ON a.lang IS NOT DISTINCT FROM b.lang AND a.lv = b.lv AND a.pos // 8 = b.pos // 8 GROUP BY ALL),
fside AS (SELECT a.lv, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r FROM fup a JOIN fup b ON a.lv = b.lv AND a.pos // 8 = b.pos // 8 GROUP BY ALL),
way AS (SELECT n.u, s.lv, s.l, s.r FROM n JOIN f ON n.lang IS NOT DISTINCT FROM f.lang JOIN side s ON s.lang IS NOT DISTINCT FROM n.lang AND s.lv < f.top AND s.pos = n.pos // (8 ** s.lv)::BIGINT
 UNION ALL SELECT n.u, f.top + s.lv, s.l, s.r FROM n JOIN f ON n.lang IS NOT DISTINCT FROM f.lang JOIN fside s ON s.pos = f.k // (8 ** s.lv)::BIGINT JOIN root ON s.lv < root.top),
proof AS (SELECT u, sha256(string_agg(l || r, '' ORDER BY lv)) AS p, max(lv) + 1 AS steps FROM way GROUP BY u),
fold AS (SELECT u, 0 AS lv, coalesce(other, leaf) AS h FROM n UNION ALL SELECT u, lv + 1, sha256(l || h || r) FROM fold JOIN way USING (u, lv))
SELECT doc_id, leaf, f.h AS subroot, root, coalesce(p, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
FROM n JOIN f ON n.lang IS NOT DISTINCT FROM f.lang CROSS JOIN root LEFT JOIN proof USING (u) JOIN fold ON fold.u = n.u AND fold.lv = coalesce(steps, 0)"""


#: Rules by their host's suffix and path; blocked urls spread over links and canonical forms by recursion.
#: References are those with a scheme or from the site's root; the others are left to the tests.
URL_FILTERS_SQL = r"""WITH RECURSIVE rules(v, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p AS (SELECT page_id, url, regexp_replace(html, '(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script\s*>|$)', ' ', 'g') AS html FROM pages),
t AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<link\b[^>]*>')) AS tag FROM p UNION ALL SELECT url, unnest(regexp_extract_all(html, '(?i)<meta\b[^>]*>')) FROM p),
v AS (SELECT url, regexp_extract(tag, '(?i)[\s"''/]href\s*=\s*["'']?([^"''>]*)', 1) AS href, regexp_extract(tag, '(?i)[\s"''/]content\s*=\s*"\s*[0-9.]+\s*[;,\s]\s*(?:url\s*=\s*)?''?([^"'']*)', 1) AS sent,
 regexp_matches(tag, '(?i)[\s"''/]rel\s*=\s*["'']?(?:[^"'']*\s)?canonical[\s"''/>]') AS canonical, regexp_matches(tag, '(?i)[\s"''/]http-equiv\s*=\s*["'']?refresh["''\s/>]') AS refresh FROM t),
r AS (SELECT url, replace(CASE WHEN canonical THEN href ELSE sent END, '&amp;', '&') AS ref FROM v WHERE canonical OR refresh),
l AS (SELECT url AS u, CASE WHEN regexp_matches(ref, '(?i)^https?://') THEN ref WHEN ref LIKE '//%' THEN regexp_extract(url, '^([^:/?#]+):', 1) || ':' || ref WHEN ref LIKE '/%' THEN regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || ref END AS w FROM r),
e0 AS (SELECT u, w FROM l WHERE u LIKE '%://%' AND w IS NOT NULL),
n0 AS (SELECT url AS x FROM pages WHERE url LIKE '%://%' UNION SELECT w FROM e0),
n1 AS (SELECT x, translate(regexp_extract(x, '(?s)^(.*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' || translate(regexp_extract(x, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(x, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS a FROM n0),
f AS (SELECT DISTINCT a, regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '^http://', 'https://'), '(?s)^([^:]*://[^/?#]*)(\?|$)', '\1/\2'), '(?i)([?&])(?:(?:utm_[a-z]+|ref|gclid|fbclid|mc_cid|mc_eid)(?:=[^&]*)?(?:&|$))+', '\1', 'g'), '[?&]$', '') AS b FROM n1),
e AS (SELECT a, b FROM f WHERE a <> b UNION SELECT x.a, y.a FROM e0 JOIN n1 x ON x.x = e0.u JOIN n1 y ON y.x = e0.w WHERE x.a <> y.a),
n AS (SELECT a AS k FROM f UNION SELECT b FROM f),
h AS (SELECT k, regexp_extract(k, '(?s)^.*?://([^/?#]*)', 1) AS host, regexp_extract(k, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM n),
j AS (SELECT k, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(v, length(rh) + length(rp)) AS v FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k),
s AS (SELECT k FROM j WHERE v = 'block' UNION SELECT CASE WHEN e.a = s.k THEN e.b ELSE e.a END FROM s JOIN e ON e.a = s.k OR e.b = s.k)
SELECT page_id, coalesce(h.host, '') AS host, coalesce(h.path, '') AS path, j.rule AS rule, coalesce(j.v, CASE WHEN s.k IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM pages LEFT JOIN n1 ON n1.x = pages.url LEFT JOIN h ON h.k = n1.a LEFT JOIN j ON j.k = n1.a LEFT JOIN s ON s.k = n1.a"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_array": SUFFIX_ARRAY_SQL, "op8_secrets": SECRETS_SQL, "op9_mixing": MIXING_SQL, "op11_periodic_runs": PERIODIC_RUNS_SQL, "op12_merkle": MERKLE_SQL, "op13_url_filters": URL_FILTERS_SQL}
