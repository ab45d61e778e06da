"""The URL filter against plain Python: hosts, rules, references and spreading."""

from __future__ import annotations

import random
from urllib.parse import urljoin

import duckdb
import pytest
from pyspark.sql import functions as F

from modsieve.llm import queries as Q
from modsieve.llm import url_filters as U

RULES = "verdict string, host string, path string"
PAGES = "page_id long, url string, html string"


def judged(spark, rows, rules, **more):
    got = U.judged(spark.createDataFrame(rows, PAGES), spark.createDataFrame(rules, RULES), **more).collect()
    return {r.page_id: r for r in got}


def link(to):
    return f'<html><head><link rel="canonical" href="{to}"></head></html>'


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com", "http://example.com/EN/", "http://badexample.com/en/", "x://a.net?/es/", "http://net/es/1", "http://a.net/es", "http://a.org/q#://b.net/es/", "ÄB://Ä.NET/fr/Ü", "http://example.com:80/en/1"]
    got = judged(spark, [(k, u, None) for k, u in enumerate(urls)], Q.URL_RULES)
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in range(len(urls))] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("example.com", "", None, "allow"), ("example.com", "/EN/", "com/", "allow"),
        ("badexample.com", "/en/", "com/", "allow"), ("a.net", "", None, "allow"), ("net", "/es/1", "net/es/", "block"), ("a.net", "/es", None, "allow"), ("a.org", "/q", None, "allow"), ("Ä.net", "/fr/Ü", "net/fr/", "block"), ("example.com:80", "/en/1", None, "allow"),
    ]


def test_blocks_spread_and_explicit_allows_stay(spark):
    rows = [
        (1, "http://a.org/1", link("http://b.org/2")), (2, "http://b.org/2", link("http://c.net/es/3")),  # chain to a url that is no page
        (3, "http://d.com/1", link("http://c.net/es/3")),  # explicitly allowed alias
        (4, "http://e.org/1", None), (5, "https://b.org/2?utm_source=feed#top", ""), (6, "HTTPS://B.org/2?ref=x&page=2", ""),
        (7, "http://f.org/1", '<meta http-equiv="Refresh" content="0; url=\'//c.net/es/3\'">'), (8, "http://g.org/1", "<!-- " + link("http://c.net/es/3") + " --><script>" + link("http://c.net/es/3") + "</script>"),
        (9, "http://h.org/1", '<link rel="stylesheet" href="http://c.net/es/3"><a href="http://c.net/es/3">canonical</a>'), (10, "http://i.org/1", None), (None, "http://a.org/1", None), (1, "http://a.org/1", None), (11, None, link("http://c.net/es/3")),
    ]
    redirects = spark.createDataFrame([("http://i.org/1", "http://f.org/1"), (None, "http://f.org/1"), ("http://e.org/1", None)], "source string, target string")
    got = judged(spark, rows, Q.URL_RULES, redirects=redirects)
    assert {k: r.verdict for k, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow", 7: "block", 8: "allow", 9: "allow", 10: "block", None: "block", 11: "allow"}
    assert got[3].rule == "com/" and got[1].rule is None


def test_references_are_resolved_as_urljoin_does(spark):
    base = "http://a.org/x/y/z.html?q=1"
    refs = ["/k", "k", "../k", "../../../k", "./k/.", "..", "?p=2", "//b.net/es/1", "https://c.org", "k/../l/./m?x=../y", "/a/b/../..", "HTTP://D.org/1"]
    df = spark.createDataFrame([(r,) for r in refs], "ref string").select("ref", U.resolved(F.lit(base), F.col("ref")).alias("got"))
    assert {r.ref: r.got for r in df.collect()} == {r: urljoin(base, r) if not r.startswith("HTTP") else r for r in refs}
    for odd in ("mailto:x@y", "javascript:1", "data:,"):
        assert spark.range(1).select(U.resolved(F.lit(base), F.lit(odd)).alias("r")).first().r is None
    row = spark.createDataFrame([(base, '<base href="/other/"><LINK href=page&amp;1 rel="x Canonical">')], "url string, html string")
    assert row.select(U.references(F.col("url"), F.col("html")).alias("r")).first().r == ["http://a.org/other/page&1"]


def test_components_equal_brute_force(spark):
    g = random.Random(3)
    n = 400
    host = lambda k: f"{'bad' if k % 37 == 0 else 'h%d' % k}.{'com' if k % 5 == 0 else 'org'}"
    urls = [f"https://{host(k)}/{k}" for k in range(n)]
    edges = [(g.randrange(n), g.randrange(n)) for _ in range(n // 3)] + [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(300, 360)]
    rows = [(k, u, "".join(link(urls[b]) for a, b in edges if a == k)) for k, u in enumerate(urls)]
    rules = [("block", "bad.org", "/"), ("allow", "com", "/")]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    own = ["allow" if host(k).endswith("com") else "block" if host(k) == "bad.org" else None for k in range(n)]
    bad = {find(k) for k in range(n) if own[k] == "block"}
    want = {k: own[k] or ("block" if find(k) in bad else "allow") for k in range(n)}
    assert {k: r.verdict for k, r in judged(spark, rows, rules).items()} == want


def test_sql_equals_the_query_where_links_exist(spark, tmp_path):
    g = random.Random(8)
    urls = [f"{g.choice(['http', 'https'])}://{g.choice(['www.', 'm.', ''])}s{k % 40}.example.{g.choice(['com', 'net', 'org'])}/{g.choice(['en', 'es', 'fr', 'de'])}/{k}{g.choice(['', '?utm_source=feed', '?page=2&ref=x', '#top'])}" for k in range(300)] + [None, "", "http://a.org"]
    spark.createDataFrame([(k, u, link(g.choice([x for x in urls if x])) if g.random() < 0.5 else None) for k, u in enumerate(urls)], PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(Q.URL_FILTERS_SQL).fetchall()
    got = [tuple(r) for r in Q.op13_url_filters(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and {r[4] for r in got if r[3] is None} == {"allow", "block"}


@pytest.mark.parametrize("which", ["pages", "rules"])
def test_empty_tables(spark, which):
    pages = spark.createDataFrame([(1, "http://a.net/es/1", "x")], PAGES).withColumn("verdict", F.lit(1)).withColumn("key", F.lit(2))
    rules = spark.createDataFrame(Q.URL_RULES, RULES)
    got = U.judged(pages.limit(0) if which == "pages" else pages, rules.limit(0) if which == "rules" else rules).collect()
    assert [r.verdict for r in got] == ([] if which == "pages" else ["allow"])


def test_no_python_runs(spark):
    plan = Q.op13_url_filters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
