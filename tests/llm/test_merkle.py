"""The Merkle manifest against a plain recursion over whole lists."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from modsieve.llm import merkle
from modsieve.llm import queries as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) by trees of plain lists."""
    first = lambda v: (v is not None, v if v is not None else 0)

    def tree(nodes):  # levels, from the nodes to one
        found = [nodes]
        while len(found[-1]) > 1:
            found.append([h(*found[-1][i : i + 8]) for i in range(0, len(found[-1]), 8)])
        return found

    def way(levels, i):
        out = []
        for level in levels[:-1]:
            a = i // 8 * 8
            out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 8])))
            i //= 8
        return out

    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = [sorted((r for r in rows if r[2] == g), key=lambda r: (first(r[0]), leaf(*r))) for g in langs]
    trees = [tree([leaf(*r) for r in g]) for g in groups]
    top = tree([t[-1][0] for t in trees])
    found = []
    for k, (g, t) in enumerate(zip(groups, trees, strict=True)):
        for i, r in enumerate(g):
            path = way(t, i) + way(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            at = leaf(r[0], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]), *r[2:]) if bad else leaf(*r)
            for left, right in path:
                at = h(left, at, right)
            found.append((r[0], leaf(*r), t[-1][0], top[-1][0], h(*(a + b for a, b in path)), at, at == top[-1][0]))
    return found


def rows_of(n, langs, seed=5):
    g = random.Random(seed)
    text = lambda: g.choice([None, "", "ÄÖ straße", "Some Words", "no capitals", "Ünï Code " * g.randint(1, 40)])
    return [(g.choice([k, k, k, None, 7]), text(), g.choice(langs), g.choice([None, "", "a:b", "ß"]), g.choice([None, k])) for k in range(n)]


def check(spark, rows, tmp_path, name="documents"):
    spark.createDataFrame(rows, DOCS).withColumn("leaf", F.lit(1)).withColumn("g", F.lit("x")).repartition(5).write.parquet(f"{tmp_path}/{name}.parquet")
    got = [tuple(r) for r in Q.op12_merkle(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(map(repr, con.execute(Q.MERKLE_SQL).fetchall())) == sorted(map(repr, got))
    return got


@pytest.mark.parametrize("n, langs", [(700, ["en", None, "de", "", "zz", "ä", "Z", "a", "b", "c"]), (1, ["en"]), (9, [None]), (65, ["x", "y"])])
def test_equals_brute_force(spark, tmp_path, n, langs):
    got = check(spark, rows_of(n, langs), tmp_path)
    assert len(got) == n and len({r[3] for r in got}) == 1


def test_superblocks_of_any_depth_give_the_same(spark):
    rows = rows_of(700, ["en", *map(str, range(30))]) + [(k, "copy", "hot", None, 1) for k in range(300)] + [(9, "same", "hot", None, 1)] * 20
    docs = spark.createDataFrame(rows, DOCS)
    found = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    want = sorted(map(repr, brute(rows)))
    for depth in (1, 2):  # superblocks of eight: many tiers
        assert sorted(map(repr, map(tuple, merkle.manifest(docs, found, depth=depth).collect()))) == want


def test_proofs_fold_to_the_root_in_sql(spark):
    docs = spark.createDataFrame([r for r in rows_of(300, ["a", "b", None])], DOCS)
    got = merkle.manifest(docs, proofs=True)
    assert got.filter(~F.col("verified")).count() == 0
    assert got.filter(merkle.folded(F.col("leaf"), F.col("lefts"), F.col("rights")) != F.col("root")).count() == 0
    assert got.filter(merkle.folded(F.sha2("leaf", 256), F.col("lefts"), F.col("rights")) == F.col("root")).count() == 0


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []
