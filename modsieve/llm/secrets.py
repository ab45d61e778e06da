"""Secret scans with multipart credential linking.

Strong patterns (keyword assignments, access keys, long hex runs) are reported as they stand.
Weak candidates (bare high-entropy tokens, account identifiers, endpoints) mean nothing alone:
an interval join pairs the parts of a document that lie within ``SCOPE`` code points of each
other, and a weak candidate is reported only when its complementary parts are there too:

* a bare token needs an identifier (an access key or an account name) in scope,
* an account name needs a secret (strong or bare token) in scope,
* an endpoint needs both an identifier and a secret in scope.

Defined cases: a null or empty text has no spans; a null doc_id stays null; repeated rows are
scanned one by one; very long texts are scanned whole, spans of any length are linked; matches of a
kind do not overlap, spans of one start come in the order of ``KINDS``; positions are code points,
ends exclusive; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .storage import text_key, unused, written

SCOPE = 400
#: Fixed patterns and least lengths of the strong kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Weak kinds.
ACCOUNT = re.compile(r"""\b(?:access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,64})""", re.I | re.A)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+", re.A)
KINDS = ("assign", "access", "hex", "account", "token", "endpoint")
#: What a kind can be in a credential: an identifier, a secret or an endpoint.
ROLE = {"assign": "secret", "access": "ident", "hex": "secret", "account": "ident", "token": "secret", "endpoint": "endpoint"}
MIN_ENTROPY = 3.5
_DIGIT = re.compile(r"[0-9]")


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def strong(text: str) -> list[tuple[int, int, str]]:
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def weak(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    clear = lambda s, e: all(e <= b[0] or s >= b[1] for b in base)
    ends = [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    out = [(m.start(), m.end(), "account") for m in ACCOUNT.finditer(text) if clear(m.start(), m.end())]
    for m in TOKEN.finditer(text):
        t = m[0]
        mixed = any(c.isdigit() for c in t) and any(c.islower() for c in t) and any(c.isupper() for c in t)
        if mixed and entropy(t) >= MIN_ENTROPY and clear(*m.span()) and all(m.end() <= s or m.start() >= e for s, e, _ in [*ends, *out]):
            out.append((*m.span(), "token"))
    return out + [x for x in ends if clear(x[0], x[1])]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _scan(batches):
    kept = ["doc", "n_assign", "n_access", "n_hex", "base", "parts"]
    for pdf in batches:
        rows = []
        for doc, text in zip(pdf.doc, pdf.text, strict=True):
            text = text if isinstance(text, str) else ""
            base = strong(text)
            n = Counter(k for *_, k in base)
            # every link needs a secret: a strong one (in ``base``), or a token, which has a digit
            more = weak(text, base) if base or _DIGIT.search(text) else []
            rows.append((doc, n["assign"], n["access"], n["hex"], _joined(base), [{"kind": k, "start": s, "end": e} for s, e, k in [*base, *more]] if more else []))
        yield pd.DataFrame(rows, columns=kept)


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Interval join over (uid, kind, start, end): the weak parts whose complement is in scope.

    A weak part is put into every cell of ``scope`` code points from its start to its end, its
    partners into every cell from ``scope`` before their start to ``scope`` after their end. Two
    parts in scope share a point of these ranges and so its cell: the join has an equality key,
    misses no pair of any length, and meeting twice does not change what is kept.
    """
    role = F.create_map(*[x for k, v in ROLE.items() for x in (F.lit(k), F.lit(v))])
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope))).alias("cell")
    parts = parts.withColumn("role", role[F.col("kind")])
    other = parts.filter("role <> 'endpoint'").select("uid", F.col("role").alias("role2"), F.col("start").alias("start2"), F.col("end").alias("end2"), cells(F.col("start") - scope, F.col("end") + scope))
    weak_parts = parts.filter(F.col("kind").isin("account", "token", "endpoint")).select("uid", "kind", "start", "end", cells(F.col("start"), F.col("end")))
    met = weak_parts.join(other, ["uid", "cell"]).filter((F.col("start2") - F.col("end") <= scope) & (F.col("start") - F.col("end2") <= scope))
    seen = met.groupBy("uid", "kind", "start", "end").agg(F.max(F.col("role2") == "ident").alias("ident"), F.max(F.col("role2") == "secret").alias("secret"))
    needs = F.when(F.col("kind") == "token", F.col("ident")).when(F.col("kind") == "account", F.col("secret")).otherwise(F.col("ident") & F.col("secret"))
    return seen.filter(needs).select("uid", "kind", "start", "end")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans): ``base`` the strong spans and ``spans`` all
    reported spans, as kind:start:end by start, then kind, comma-joined."""
    found = _spans(docs.select(F.col("doc_id").cast("long").cast("string").alias("doc"), F.col("text").cast("string").alias("text")))
    return found.select(F.col("doc").cast("long").alias("doc_id"), "n_assign", "n_access", "n_hex", "base", "spans")


def _spans(docs: DataFrame) -> DataFrame:
    """``scan`` of rows (doc, text) named by any text, with a row's number ``uid``."""
    # written once, the rows' numbers hold
    found = written(docs.mapInPandas(_scan, "doc string, n_assign long, n_access long, n_hex long, base string, parts array<struct<kind:string,start:long,end:long>>").withColumn("uid", F.monotonically_increasing_id()), "spans")
    parts = found.filter(F.size("parts") > 0).select("uid", F.inline("parts"))
    added = linked(parts).groupBy("uid").agg(F.collect_list(F.struct("start", "end", "kind")).alias("added"))
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    both = F.concat(F.filter("parts", lambda p: p["kind"].isin("assign", "access", "hex")), F.transform("added", lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"))))
    ordered = F.array_sort(F.transform(both, lambda p: F.struct(p["start"], order[p["kind"]].alias("k"), p["end"], p["kind"])))
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_join(F.transform(ordered, lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), ","))
    return found.join(added, "uid", "left").select("doc", "uid", "n_assign", "n_access", "n_hex", "base", spans.alias("spans"))


@F.pandas_udf(StringType())
def _masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, own in zip(texts, spans, strict=True):
        if isinstance(own, str) and own and isinstance(text, str):
            pieces, at = [], 0
            for s, e in sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in own.split(","))):
                if s >= at:
                    pieces += [text[at:s], "[SECRET]"]
                at = max(at, e)
            text = "".join([*pieces, text[at:]])
        out.append(text)
    return pd.Series(out, dtype=object)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every reported span replaced by [SECRET] and ``n_chars`` set anew there.

    Spans are matched to rows by doc_id and the SHA-256 of the text, so repeated ids do no harm;
    rows without spans stay as they are."""
    key, (k, s, new) = text_key(docs["doc_id"], docs["text"]), unused(docs, "_key", "_spans", "_new")
    found = _spans(docs.select(key.alias("doc"), docs["text"].cast("string").alias("text"))).filter("spans <> ''").groupBy(F.col("doc").alias(k)).agg(F.first("spans").alias(s))
    both = docs.join(found, key == F.col(k), "left")
    hit = F.col(s).isNotNull()
    out = both.withColumn(new, F.when(hit, _masked(docs["text"], F.col(s))).otherwise(docs["text"])).withColumn("text", F.col(new))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
