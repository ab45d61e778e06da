"""A Merkle manifest of a dataset, with proofs of every row, by exchange of subtrees.

A row's leaf is the SHA-256 of its fields. Leaves of one language, in order of doc_id, form a tree
of fan-out 8 (a run at the end may be shorter; its hash goes up a level all the same), and the
roots of the languages, in bytewise order, form a tree over them. Digests are lowercase hexadecimal
text and are hashed as such.

Leaves are numbered within their language by a range partitioning whose partitions count their rows,
so no task orders a language. Superblocks of 8 ** LEVELS consecutive nodes are reduced to one node each; the
nodes that come out are numbered superblocks of the next tier, until one is left. On the way back
each tier's nodes are cogrouped by superblock with the nodes outside it that a proof needs: one row
of siblings for each level above the superblock. One function then finishes the superblock's own
levels, joins the proofs and folds them. A group has 4096 small rows and one outer row at most.

Defined cases: null fields count as ``-``; a null doc_id comes before all others; a null language is
a tree of its own, before all others; an empty text is ``0:``; rows of one doc_id and language are
ordered by their leaves, and equal rows by the order in which they were read, which changes no digest; a
single row is its tree's root, with an empty proof; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written

FAN = 8
#: Levels of a superblock, if not stated.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels(n: int) -> int:
    """Levels above ``n`` nodes."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def leaf_of(columns: dict[str, Column]) -> Column:
    """The leaf of a row: each field as its UTF-8 length and value, ``-`` if null."""
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in columns.values())), 256)


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its proof give: for readers who check a proof by themselves."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), leaf, lambda h, s: F.sha2(F.concat(s.getField("l"), h, s.getField("r")), 256))


def _up(digests: list[str], depth: int) -> list[list[str]]:
    """The levels of one superblock, its own nodes first."""
    tree = [digests]
    for _ in range(depth):
        below = tree[-1]
        tree.append([_h("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return tree


def _siblings(level: list[str], i: int) -> tuple[str, str]:
    a = i - i % FAN
    return "".join(level[a:i]), "".join(level[i + 1 : a + FAN])


def _paths(digests: list[str], depth: int, lefts: list[str], rights: list[str]) -> list[tuple[list[str], list[str]]]:
    """For each node of a superblock the siblings on its way to the root, the superblock's outer ones last."""
    tree = _up(digests, depth)
    above = [(lefts, rights)]
    for level in reversed(tree[:-1]):
        found = []
        for i in range(len(level)):
            left, right = _siblings(level, i)
            far = above[i // FAN]
            found.append(([left, *far[0]], [right, *far[1]]))
        above = found
    return above


def _reduced(key: tuple, pdf: pd.DataFrame, depth: int) -> pd.DataFrame:
    pdf = pdf.sort_values("pos")
    n = int(pdf["n"].iloc[0])
    top = _up(pdf["digest"].tolist(), min(depth, levels(n)))[-1][0]
    return pd.DataFrame({"g": [key[0]], "pos": [key[1]], "digest": [top], "n": [-(-n // FAN**depth)]})


def _inside(pdf: pd.DataFrame, outer: pd.DataFrame, depth: int) -> pd.DataFrame:
    """Proofs of a tier's nodes, which are the outer rows of the tier below."""
    pdf = pdf.sort_values("pos")
    paths = _paths(pdf["digest"].tolist(), min(depth, levels(int(pdf["n"].iloc[0]))), list(outer["lefts"].iloc[0]), list(outer["rights"].iloc[0]))
    return pd.DataFrame({"g": pdf["g"], "pos": pdf["pos"], "lefts": [x for x, _ in paths], "rights": [x for _, x in paths], "subroot": outer["subroot"].iloc[0]})


def _finished(pdf: pd.DataFrame, outer: pd.DataFrame, depth: int, proofs: bool) -> pd.DataFrame:
    """Local reduction, proofs and folding of one superblock of leaves."""
    pdf = pdf.sort_values("pos")
    leaves = pdf["digest"].tolist()
    paths = _paths(leaves, min(depth, levels(int(pdf["n"].iloc[0]))), list(outer["lefts"].iloc[0]), list(outer["rights"].iloc[0]))
    roots = []
    for leaf, other, (lefts, rights) in zip(leaves, pdf["other"].tolist(), paths, strict=True):
        at = other if isinstance(other, str) else leaf
        for left, right in zip(lefts, rights, strict=True):
            at = _h(left + at + right)
        roots.append(at)
    proof = [_h("".join(x + y for x, y in zip(lefts, rights, strict=True))) for lefts, rights in paths]
    out = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "leaf": leaves, "subroot": outer["subroot"].iloc[0], "proof_sha256": proof, "folded_root": roots})
    return out.assign(lefts=[x for x, _ in paths], rights=[x for _, x in paths]) if proofs else out


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``pos``, the place in its group ``g`` by ``order``, from 0, and ``n``, the group's rows."""
    placed = df.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    placed = written(placed.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), f"{name}-placed")
    # a group's rows in one partition follow each other; a group has a row for each partition at most
    parts = placed.groupBy("g", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = F.sum("rows").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("g", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy("g")).alias("n"))
    return written(placed.join(parts, ["g", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before"), name)


def _block(df: DataFrame, depth: int) -> DataFrame:
    return df.withColumn("block", F.floor(F.col("pos") / FAN**depth).cast("long"))


def _tiers(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """Tables of nodes (g, pos, digest, n), each of the superblocks of the one before, up to one node a group."""

    def reduce(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _reduced(key, pdf, depth)

    found = [nodes]
    while (found[-1].agg(F.max("n").alias("n")).first().n or 0) > 1:
        blocks = _block(found[-1].select("g", "pos", "digest", "n"), depth).groupBy("g", "block")
        found.append(written(blocks.applyInPandas(reduce, "g string, pos long, digest string, n long"), "merkle-nodes"))
    return found


_OUTER = "g string, pos long, lefts array<string>, rights array<string>, subroot string"


def _meet(nodes: DataFrame, outer: DataFrame, depth: int, function, schema: str) -> DataFrame:
    return _block(nodes, depth).groupBy("g", "block").cogroup(outer.withColumnRenamed("pos", "block").groupBy("g", "block")).applyInPandas(function, schema)


def manifest(docs: DataFrame, found_text: Column | None = None, proofs: bool = False, depth: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    ``found_text`` is the text as it is now, where it may differ from what the manifest was made of:
    ``folded_root`` comes from the leaf with that text and the proof, and ``verified`` says whether it
    is the root. With ``proofs`` the siblings to the left and right, level by level, are columns too.
    A superblock has ``depth`` levels."""
    fields = {c: F.col(c).cast("long").cast("string") if c in ("doc_id", "n_chars") else F.col(c).cast("string") for c in FIELDS}
    other = F.lit(None).cast("string")
    if found_text is not None:
        other = F.when(~found_text.eqNullSafe(fields["text"]), leaf_of(fields | {"text": found_text}))
    # "" sorts before all languages, and "=" before each keeps their bytewise order
    group = F.coalesce(F.concat(F.lit("="), fields["lang"]), F.lit(""))
    leaves = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), group.alias("g"), leaf_of(fields).alias("digest"), other.alias("other"), F.monotonically_increasing_id().alias("row")), "leaves")
    leaves = _numbered(leaves, ["doc_id", "digest", "row"], "numbered").drop("row")
    trees = _tiers(leaves, depth)
    tops = trees[-1].select("g", "digest")
    forest = _tiers(_numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("lang"), "digest"), ["lang"], "languages"), depth)
    root = forest[-1].first()
    root = root.digest if root else None

    def inside(key: tuple, pdf: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        return _inside(pdf, outer, depth)

    outer = forest[-1].select("g", "pos", F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"), F.lit(None).cast("string").alias("subroot"))
    for nodes in reversed(forest[:-1]):
        outer = _meet(nodes.select("g", "pos", "digest", "n"), outer, depth, inside, _OUTER)
    outer = forest[0].select("g", "pos", "lang", "digest").join(outer.drop("subroot"), ["g", "pos"])
    outer = written(outer.select(F.col("lang").alias("g"), F.lit(0).cast("long").alias("pos"), "lefts", "rights", F.col("digest").alias("subroot")), "merkle-outer")
    for nodes in reversed(trees[1:-1]):
        outer = written(_meet(nodes, outer, depth, inside, _OUTER), "merkle-outer")
    # a tree of one leaf is its own superblock, as is the top of each tree
    def finish(key: tuple, pdf: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        return _finished(pdf, outer, depth, proofs)

    out = _meet(leaves, outer, depth, finish, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string" + (", lefts array<string>, rights array<string>" if proofs else ""))
    root = F.lit(root).cast("string")
    columns = ["doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")]
    return out.select(*columns, *(["lefts", "rights"] if proofs else []))
