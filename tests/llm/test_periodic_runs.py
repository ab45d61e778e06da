"""Periodic runs against comparison of every word with the word a period later."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from modsieve.llm import periodic_runs as P
from modsieve.llm import queries as Q
from modsieve.llm import words as W

SPACE = "".join(map(chr, (0x20, *range(0x09, 0x0E))))


def brute(w):
    """(start, length, period) by start, then period."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((i, length, q) for (i, length), q in found.items()), key=lambda r: (r[0], r[2]))


def split(text):
    return [x for x in "".join(" " if c in SPACE else c for c in text or "").split(" ") if x]


def wanted(doc_id, text):
    w = split(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha256(lines.encode()).hexdigest(), sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def sample(n, seed):
    g = random.Random(seed)
    rows = [(None, "a a a a a a b"), (1, None), (2, ""), (3, "   \t\n"), (4, "a A a A a A a A"), (5, "\xa0x y\x0bx y\rx\x0cy x y x")]
    for k in range(n):
        pool = g.choice(["ab", "abc", "abcdefgh"]) if g.random() < 0.6 else [f"w{i}é" for i in range(200)]
        w = [g.choice(pool) for _ in range(g.randint(0, 120))]
        for _ in range(g.randint(0, 3)):
            at = g.randint(0, len(w))
            part = [g.choice(pool) for _ in range(g.randint(1, 9))]
            w[at:at] = (part * 6)[: g.randint(1, 6 * len(part))]
        rows.append((1000 + k, g.choice([" ", "\n", "  "]).join(w)))
    return rows


def test_every_run_of_random_words():
    g = random.Random(1)
    for _ in range(1500):
        w = [g.choice("abcd"[: g.choice([1, 2, 2, 3, 4])]) for _ in range(g.randint(1, 60))]
        if g.random() < 0.5 and len(w) > 10:
            p, a = g.randint(1, len(w) // 4), g.randint(0, len(w) - 1)
            w = [x if i < a + p else w[a + (i - a) % p] for i, x in enumerate(w)]
        h, rows, _, _ = W.placed(*W.buffers(pa.array([" ".join(w)])), "space")
        starts, ends = P.nearby(h, rows)
        b = [x.encode() for x in w]
        near = P.document_runs(b, starts.tolist(), ends.tolist()).tolist() if len(starts) else []
        assert near == [list(r) for r in brute(w)] == P.document_runs(b, [0], [len(w)]).tolist()


def test_extensions_equal_comparison():
    g = random.Random(4)
    s = [g.randrange(2) for _ in range(200)] + [9]
    ext = P.Extensions(s)
    i, j = np.array([(a, b) for a in range(0, 200, 3) for b in range(200) if a != b]).T
    want = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        k = 0
        while s[a + k] == s[b + k]:
            k += 1
        want.append(k)
    assert ext(i, j).tolist() == want
    assert P.euler_tour(s)[0].tolist() == sorted(range(201), key=lambda x: s[x:])


def test_query_and_sql_equal_brute_force(spark, tmp_path):
    g = random.Random(6)
    rows = sample(600, 2) + [(7, "x y " * 3000), (8, " ".join(str(i % 701) for i in range(5000))), (9, " ".join(g.choice("ab") for _ in range(2000))), (9, "again " * 6), (2**63 - 1, "a b " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit(1)).withColumn("runs", F.lit("x")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, map(tuple, Q.op11_periodic_runs(spark, str(tmp_path)).collect())))
    assert got == sorted(repr(wanted(*r)) for r in rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(repr, con.execute(Q.PERIODIC_RUNS_SQL).fetchall())) == got


@pytest.mark.parametrize("text, runs, kept", [("go stop go stop go stop go stop now", [(0, 8, 2)], "go stop now"), ("a a a a a", [], "a a a a a"), ("", [], ""), (None, [], "")])
def test_operator_gives_spans_and_text(spark, text, runs, kept):
    r = P.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r.runs] == runs and r.collapsed == kept and r.n_words == len(split(text))


def test_empty_table(spark):
    assert P.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
