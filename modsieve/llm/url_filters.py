"""URL filters with redirect equivalence, with DataFrame functions only.

A rule has a verdict, a host and a path. It fits a url whose host is the rule's or a subdomain of
it and whose path starts with the rule's; of the rules that fit, the longest decides. A url that no
rule fits gets the verdict of its aliases: urls are linked by redirects and canonical links, and a
block decision of any url spreads through the connected component. An explicit allow has precedence:
a url that a rule allows stays allowed whatever its component holds. What no decision reaches is allowed.

Edges come from the pages themselves (``link`` elements whose ``rel`` has ``canonical``, ``meta``
elements that refresh to another url), from a table of redirects where one is given, and from each
url's canonical form: https, without tracking parameters. Components are
found by smallest labels with pointer jumping over written tables (``near_duplicates.components``);
a hub of many aliases is one key of joins that Spark may split and of sums that are aggregated first.

Defined cases: a null url, or one without ``://``, has empty host and path, no rule and no aliases,
and is allowed; null html has no edges; comments and scripts hold no edges; references are
resolved against the url (or the page's ``base``), those that aren't http or https are left out; fragments
and the case of scheme and host don't tell urls apart; urls are compared by SHA-256. Rows that repeat a
url share its edges. Of two fitting rules of one length the one with the longer host decides, of rules that are equal
a block. A tag ends at its first ``>``. Empty tables give empty results, no rules allow all; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .near_duplicates import components
from .storage import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that only say where a visitor came from.
TRACKING = ("utm_[a-z]+", "ref", "gclid", "fbclid", "mc_cid", "mc_eid")
_UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)"
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def lowered(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?i)(?<=[\s\"'/]){name}{_VALUE}"
    value = F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))
    return F.trim(F.regexp_replace(value, r"(?i)&(?:amp|#38|#x26);", "&"))


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments taken out."""
    parts = F.split(F.regexp_replace(path, r"(?:^|/)\.{1,2}$", "$0/"), "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.least(F.size(done), F.lit(1))))).otherwise(F.concat(done, F.array(s))),
    )
    return F.array_join(kept, "/")


def resolved(base: Column, ref: Column) -> Column:
    """The absolute http or https url that ``ref`` names on a page at ``base``; null if there is none."""
    scheme, site = F.regexp_extract(base, r"\A([^:/?#]+)://", 1), F.regexp_extract(base, r"\A([^:/?#]+://[^/?#]*)", 1)
    path, query = F.regexp_extract(base, r"\A[^:/?#]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(base, r"(\?[^#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)\A(.*/)", 1))
    plain, rest = F.regexp_extract(ref, r"(?s)\A([^?#]*)", 1), F.regexp_extract(ref, r"(?s)\A[^?#]*(\?[^#]*)?", 1)
    full = (
        F.when(ref.rlike(r"(?i)\Ahttps?://[^/?#]"), ref).when(ref.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref)).when(plain == "", F.concat(site, path, F.when(rest == "", query).otherwise(rest)))
        .otherwise(F.concat(site, _without_dots(F.when(plain.startswith("/"), plain).otherwise(F.concat(folder, plain))), rest))
    )
    return F.when(base.rlike(r"(?i)\Ahttps?://[^/?#]"), full)


def address(url: Column) -> Column:
    """What tells urls apart: scheme and host in lower case, path and query; null without ``://``."""
    scheme, query = lowered(F.regexp_extract(url, r"(?s)\A(.*?)://", 1)), F.regexp_extract(url, r"(?s)\A.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host_of(url), path_of(url), query))


def canonical_form(url: Column) -> Column:
    """An address by https, with a path and without tracking parameters."""
    tracking = "|".join(TRACKING)
    plain = F.regexp_replace(url, r"\Ahttp://", "https://")
    plain = F.regexp_replace(plain, r"(?s)\A(.*?://[^/?#]*)(?=\?|\z)", "$1/")
    plain = F.regexp_replace(plain, rf"(?i)(?<=[?&])(?:{tracking})(?:=[^&]*)?(?:&|\z)", "")
    return F.regexp_replace(plain, r"[?&]\z", "")


def references(url: Column, html: Column) -> Column:
    """The urls a page calls its canonical form or sends its reader to."""
    seen = F.regexp_replace(html, _UNSEEN, " ")
    tags = lambda name: F.regexp_extract_all(seen, F.lit(rf"(?i)<{name}\b[^>]*>"), F.lit(0))
    base = F.try_element_at(F.filter(F.transform(tags("base"), lambda t: _attribute(t, "href")), lambda h: h != ""), F.lit(1))
    base = F.coalesce(resolved(url, base), url)
    links = F.transform(F.filter(tags("link"), lambda t: _attribute(t, "rel").rlike(r"(?i)(?:\A|\s)canonical(?:\s|\z)")), lambda t: _attribute(t, "href"))
    content = F.transform(F.filter(tags("meta"), lambda t: lowered(_attribute(t, "http-equiv")) == "refresh"), lambda t: _attribute(t, "content"))
    sent = F.transform(content, lambda c: F.trim(F.regexp_extract(c, r"""(?is)\A\s*[\d.]+\s*[;,\s]\s*(?:url\s*=\s*)?["']?([^"']*)""", 1)))
    found = F.transform(F.filter(F.concat(links, sent), lambda r: r != ""), lambda r: resolved(base, r))
    return F.when(html.rlike("(?i)canonical|refresh"), F.filter(found, lambda r: r.isNotNull()))


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with unique ``key``, ``host``, ``path``) that a rule fits: (key, rule, verdict).

    Every url meets the rules of its host's suffixes, which start at its labels."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = urls.filter("host <> ''").select("key", "path", F.explode(suffixes).alias("rule_host")).join(rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict"), "rule_host")
    fits = met.filter(F.expr("startswith(path, rule_path)"))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), (F.col("verdict") == "block").alias("blocks"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    return fits.groupBy("key").agg(F.max(rank).alias("best")).select("key", "best.rule", "best.verdict")


def judged(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url, html).

    ``rules`` has (verdict, host, path), ``redirects``, if given, (source, target) urls."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long"), url.alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("address"), F.transform(references(F.col("url"), F.col("html")), address).alias("targets"))
    digest = lambda c: F.unhex(F.sha2(c, 256))
    rows = written(rows.withColumn("key", digest(F.col("address"))), "urls")

    links = rows.select("address", F.explode("targets").alias("target"))
    if redirects is not None:
        links = links.unionByName(redirects.select(address(F.col("source").cast("string")).alias("address"), address(F.col("target").cast("string")).alias("target")))
    links = written(links.filter("address is not null and target is not null").distinct(), "url-links")
    named = rows.select("address").unionByName(links.select("address")).unionByName(links.select(F.col("target").alias("address"))).filter("address is not null").distinct()
    forms = written(named.select("address", canonical_form(F.col("address")).alias("target")), "url-forms")
    every = written(forms.select("address").unionByName(forms.select(F.col("target").alias("address"))).distinct().select(digest(F.col("address")).alias("key"), host_of(F.col("address")).alias("host"), path_of(F.col("address")).alias("path")), "url-nodes")
    own = written(ruled(every, rules), "url-rules")

    edges = links.unionByName(forms).filter("address <> target").select(digest(F.col("address")).alias("a"), digest(F.col("target")).alias("b"))
    label = components(edges, "aliases").select(F.col("node").alias("key"), "label")
    blocked = label.join(own.filter("verdict = 'block'").select("key"), "key", "left_semi").select("label").distinct()
    reached = label.join(blocked, "label", "left_semi").select("key", F.lit("block").alias("spread"))
    out = rows.join(own, "key", "left").join(reached, "key", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "spread", F.lit("allow")).alias("verdict"))
