"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five words; a shingle's weight is its count in the text times the mean inverse
document frequency of its words. Document frequencies cover all documents, in a table of a fixed
number of hashed cells. Each of K sampling functions picks one (shingle, level) of a document so
that two documents agree with a probability equal to their weighted Jaccard similarity; bands of
samples propose candidates, and the exact weighted Jaccard similarity verifies them. The sampler
rounds weights to powers of 2 ** (1 / LEVELS); the verification doesn't.

Exact copies are one node from the start. The member of a bucket that shares most buckets leads
it, and every other member is compared with the leader first. No member leaves its bucket for
that: members of a bucket stay comparable until they are in one class or have been compared. Two
of a bucket's members are compared if an upper bound of their similarity, taken from weights
summed over ``CELL_SUMS`` hashed cells, reaches the threshold. First every member meets only its
best partner of another class (``BEST_ROUNDS`` rounds, which join most of a group with few
comparisons), then all that are left of different classes. So each pair of a bucket is linked,
in one class by other links, or known to be below the threshold. Classes are the connected
components of the verified links. Large buckets are cut into blocks of ``BLOCK`` members, and
every two blocks meet.

Defined cases: null and empty texts and texts without words are alone; texts of fewer than five
words are one shingle; very long texts are shingled whole; a class is named by its smallest doc_id,
or null if all its rows lack one; a doc_id that several texts share belongs to each text's class;
repeated rows are copies; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import unused, written

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4
K = BANDS * ROWS
CELLS = 1 << 18
#: Rows of the table of random numbers; a shingle's hash picks its row.
TABLE = 1 << 13
#: Weights are rounded to powers of 2 ** (1 / LEVELS); of the first TABLED powers values are tabled.
LEVELS = 4
TABLED = 24
#: Cells of the upper bound, members of a block, rounds in which a member meets one partner only.
CELL_SUMS = 128
BLOCK = 512
BEST_ROUNDS = 2
_LOW = np.uint64((1 << 48) - 1)


def _word_counts(batches):
    """(cell, documents) of this task; cell -1 counts the documents themselves."""
    total, docs = np.zeros(CELLS, np.int64), 0
    for b in batches:
        raw, off = W.buffers(b.column(0))
        docs += len(off) - 1
        for i, j in W.groups(off):
            h, wo = W.hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            row = np.repeat(np.arange(j - i, dtype=np.uint64), np.diff(wo))
            seen = np.unique((row << np.uint64(18)) | (h & np.uint64(CELLS - 1)))
            total += np.bincount((seen & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    cell = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(cell, -1)), pa.array(np.append(total[cell], docs))], names=["cell", "n"])


def idf_table(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of every hashed word cell: ``CELLS`` numbers."""
    parts = docs.select(F.col("text").cast("string")).mapInArrow(_word_counts, "cell long, n long")
    rows = parts.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most CELLS + 1 rows
    n = int(rows.n[rows.cell == -1].sum())
    df = np.zeros(CELLS)
    own = rows[rows.cell >= 0]
    df[own.cell.to_numpy()] = own.n.to_numpy()
    return (1 + np.log((1 + n) / (1 + df))).astype(np.float32)


def weighted(raw: np.ndarray, off: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct shingles (48 bits), sorted, with their weights, these as levels for the
    sampler, and the rows' offsets."""
    h, wo = W.hashes(raw, off)
    sh, so = W.shingles(h, wo, WORDS)
    n = len(off) - 1
    if not len(sh):
        return np.empty(0, np.uint64), np.empty(0), np.empty(0, np.int64), np.zeros(n + 1, np.int64)
    total = np.concatenate([[0.0], np.cumsum(idf[(h & np.uint64(CELLS - 1)).astype(np.int64)], dtype=np.float64)])
    counts = np.diff(so)
    row = np.repeat(np.arange(n), counts)
    first = wo[row] + np.arange(len(sh)) - so[row]
    last = np.minimum(first + WORDS, wo[row + 1])
    weight = (total[last] - total[first]) / np.maximum(last - first, 1)
    out_h, out_w, out_o = [], [], [0]
    for k in range(0, n, 1 << 15):  # the row's number takes the 16 bits above a shingle's 48
        a, b = so[k], so[min(n, k + (1 << 15))]
        key = ((row[a:b] - k).astype(np.uint64) << np.uint64(48)) | (sh[a:b] & _LOW)
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        tf = np.diff(np.append(new, len(key)))
        out_h.append(key[new] & _LOW)
        out_w.append(weight[a:b][order[new]] * tf)
        per = np.bincount((key[new] >> np.uint64(48)).astype(np.int64), minlength=min(n - k, 1 << 15))
        out_o.extend((out_o[-1] + np.cumsum(per)).tolist())
    w = np.concatenate(out_w)
    return np.concatenate(out_h), w, np.maximum(0, np.rint(LEVELS * np.log2(w))).astype(np.int64), np.array(out_o)


class Sampler:
    """Improved consistent weighted sampling with tabled random numbers.

    A shingle's hash picks a row of Gamma(2, 1) numbers r, c and uniform numbers beta, one of each
    for each function. Weights are powers of 2 ** (1 / LEVELS), so for the usual ones the value
    ln a = ln c - r (floor(ln w / r + beta) - beta + 1) comes from a table; a function picks the
    shingle with the smallest value, the smallest hash of equals."""

    def __init__(self) -> None:
        g = np.random.default_rng(1009)
        self.r = g.gamma(2, 1, (TABLE, K)).astype(np.float32)
        self.c = np.log(g.gamma(2, 1, (TABLE, K))).astype(np.float32)
        self.beta = g.random((TABLE, K), np.float32)
        every = np.arange(TABLE)
        self.known = np.concatenate([self.value(np.full(TABLE, n), every) for n in range(TABLED)])

    def level_of(self, level: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.floor(level.astype(np.float32)[:, None] * np.float32(np.log(2) / LEVELS) / self.r[row] + self.beta[row])

    def value(self, level: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.c[row] - self.r[row] * (self.level_of(level, row) - self.beta[row] + 1)

    def __call__(self, h: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The K samples of one document, each a 64-bit hash of (function, shingle, level)."""
        row = (h % np.uint64(TABLE)).astype(np.int64)
        best = np.full(K, np.inf, np.float32)
        pick = np.zeros(K, np.int64)
        for at in range(0, len(h), 4096):
            n, w = row[at : at + 4096], level[at : at + 4096]
            a = self.known.take(np.minimum(w, TABLED - 1) * TABLE + n, axis=0)
            rare = np.flatnonzero(w >= TABLED)
            if len(rare):
                a[rare] = self.value(w[rare], n[rare])
            low = a.min(axis=0)
            i, k = np.nonzero(a == low)
            first = np.empty(K, np.int64)
            first[k[::-1]] = i[::-1]  # the first place of each function's least value
            better = low < best
            best[better], pick[better] = low[better], first[better] + at
        every = np.arange(K)
        t = np.floor(level[pick].astype(np.float32) * np.float32(np.log(2) / LEVELS) / self.r[row[pick], every] + self.beta[row[pick], every])
        return W.mix(h[pick] + (t.astype(np.int64).astype(np.uint64) << np.uint64(50)) + every.astype(np.uint64) * np.uint64(W._BASE))


def _signatures(batches, idf):
    sampler = Sampler()
    for b in batches:
        raw_all, off_all = W.buffers(b.column(2))
        for i, j in W.groups(off_all):
            h, _, w, o = weighted(raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i], idf)
            bands = []
            for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True):
                if x == y:
                    bands.append(None)
                    continue
                s = sampler(h[x:y], w[x:y]).reshape(BANDS, ROWS)
                acc = np.arange(BANDS, dtype=np.uint64)
                for k in range(ROWS):
                    acc = W.mix(acc * np.uint64(W._BASE) + s[:, k])
                bands.append(acc.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "copy", "bands"])


def _packed(batches):
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress((t or "").encode()) for t in b.column(1).to_pylist()], pa.binary())], names=["copy", "z"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted weighted sets."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    both = float(np.minimum(a[1][same], b[1][at[same]]).sum(dtype=np.float64))
    total = float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - both
    return both / total if total else 0.0


def _compare(batches, idf):
    z = zstandard.ZstdDecompressor()

    def load(packed: bytes):
        raw = np.frombuffer(z.decompress(packed), np.uint8)
        return weighted(raw, np.array([0, len(raw)]), idf)[:2]

    leader, own = None, None
    for pdf in batches:
        scores = []
        for lead, zl, zd in zip(pdf.leader, pdf.z_leader, pdf.z, strict=True):
            if lead != leader:
                leader, own = lead, load(zl)
            scores.append(similarity(own, load(zd)))
        yield pd.DataFrame({"leader": pdf.leader, "doc": pdf.doc, "similarity": scores})


def _sketches(batches, idf):
    """(doc, total, cells): a text's weight and its sums over hashed cells, as half-precision bytes."""
    z = zstandard.ZstdDecompressor()
    for pdf in batches:
        totals, cells = [], []
        for packed in pdf.z:
            raw = np.frombuffer(z.decompress(packed), np.uint8)
            h, w, _, _ = weighted(raw, np.array([0, len(raw)]), idf)
            totals.append(float(w.sum()))
            with np.errstate(over="ignore"):
                cells.append(np.bincount((h % np.uint64(CELL_SUMS)).astype(np.int64), weights=w, minlength=CELL_SUMS).astype(np.float16).tobytes())
        yield pd.DataFrame({"doc": pdf.doc, "total": totals, "cells": cells})


def _partners(group: pd.DataFrame, threshold: float, best: bool) -> list[tuple[int, int]]:
    """Pairs of two blocks (of one, if it has no second) in different classes whose bound reaches ``threshold``."""
    group = group.sort_values("side", kind="stable")
    doc, comp, total, side = (group[c].to_numpy() for c in ("doc", "comp", "total", "side"))
    cells = np.frombuffer(b"".join(group.cells), np.float16).reshape(len(group), CELL_SUMS).astype(np.float32)
    cut = int((side == 0).sum())
    one = cut == len(side)
    top, top_at = np.full(len(doc), -1.0), np.full(len(doc), -1)
    out = []
    for i in range(cut):
        at = np.arange(i + 1 if one else cut, len(doc))
        at = at[(comp[at] != comp[i]) & (np.minimum(total[at], total[i]) >= threshold * 0.999 * np.maximum(total[at], total[i]))]
        if not len(at):
            continue
        # half-precision sums are right to 1 in 2048, so the bound stays one with 1.001
        both = np.minimum(np.minimum(cells[at], cells[i]).sum(axis=1) * 1.001, np.minimum(total[at], total[i]))
        bound = both / (total[at] + total[i] - both)
        ok = bound >= threshold * 0.999
        at, bound = at[ok], bound[ok]
        if not len(at):
            continue
        if not best:
            out += [(doc[i], d) for d in doc[at]]
            continue
        k = int(np.argmax(bound))
        if bound[k] > top[i]:
            top[i], top_at[i] = bound[k], at[k]
        better = bound > top[at]
        top[at[better]], top_at[at[better]] = bound[better], i
    if best:
        out = [(doc[i], doc[k]) for i, k in enumerate(top_at.tolist()) if k >= 0]
    return [(min(x, y), max(x, y)) for x, y in out]


def _meet(batches, threshold: float, best: bool):
    """(a, b) of every group of blocks; groups are runs of equal (bucket, low, high) rows."""
    rest = None
    for pdf in _then_none(batches):
        if pdf is not None:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if rest is None or not len(rest):
            continue
        key = rest[["bucket", "low", "high"]].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        ends = np.append(starts[1:], len(rest))
        whole = len(starts) - (pdf is not None)
        found: set[tuple[int, int]] = set()
        for s, e in zip(starts[:whole].tolist(), ends[:whole].tolist(), strict=True):
            if e - s > 1:
                found.update(_partners(rest.iloc[s:e], threshold, best))
        rest = rest.iloc[starts[-1] :].reset_index(drop=True) if pdf is not None else None
        yield pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")


def _then_none(batches):
    yield from batches
    yield None


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label): every node of (a, b) edges with the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours, then the label's own
    label; rounds grow with the logarithm of the longest path."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = written(step.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("label")), name)
        if not new.filter("label <> old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")


def verified_links(docs: DataFrame, nodes: DataFrame, idf: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b, similarity) between nodes (doc, copy, bands), with weighted Jaccard ``threshold``
    or more; ``copy`` is the SHA-256 of a node's text, which tells it from all others."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(idf)  # CELLS numbers
    rows = nodes.select("doc", F.posexplode("bands").alias("band", "hash"))
    sizes = rows.groupBy("band", "hash").agg(F.count("*").alias("size")).filter("size > 1")
    met = written(rows.join(sizes, ["band", "hash"]), "buckets")
    degree = met.groupBy("doc").agg(F.sum("size").alias("degree"))
    bucket = written(met.join(degree, "doc").select(F.xxhash64("band", "hash").alias("bucket"), "doc", "degree"), "members")
    text = F.col("text").cast("string")
    packed = docs.select(_copy(text).alias("copy"), text.alias("text")).mapInArrow(_packed, "copy binary, z binary")
    wanted = nodes.select("doc", "copy").join(degree.select("doc"), "doc", "left_semi")
    texts = written(packed.join(wanted, "copy").select("doc", "z").dropDuplicates(["doc"]), "texts", "uncompressed")

    def compare(batches):
        yield from _compare(batches, shared.value)

    def sketch(batches):
        yield from _sketches(batches, shared.value)

    def score(edges: DataFrame) -> DataFrame:
        loaded = edges.join(texts, "doc").join(texts.select(F.col("doc").alias("leader"), F.col("z").alias("z_leader")), "leader").select("leader", "doc", "z_leader", "z")
        return written(loaded.mapInPandas(compare, "leader long, doc long, similarity double").select(F.least("leader", "doc").alias("a"), F.greatest("leader", "doc").alias("b"), "similarity"), "scores")

    lead = bucket.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("doc")).alias("minus"))).alias("top"), F.count("*").alias("size")).filter("size > 1").select("bucket", (-F.col("top.minus")).alias("leader"), "size")
    led = written(bucket.join(lead, "bucket").filter("doc <> leader"), "pairs")
    scored = score(led.select("leader", "doc").distinct())
    # a leader has met its whole bucket
    rest = led.filter("size > 2").select("bucket", "doc")
    sketches = None
    for turn in range(BEST_ROUNDS + 1):
        label = components(scored.filter(F.col("similarity") >= threshold))
        named = rest.join(label.withColumnRenamed("node", "doc"), "doc", "left").select("bucket", "doc", F.coalesce("label", "doc").alias("comp"))
        open_ = named.groupBy("bucket").agg(F.count("*").alias("size"), F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most").select("bucket", "size")
        left = written(named.join(open_, "bucket"), "open")
        rest = left.select("bucket", "doc")
        if not left.limit(1).count():
            break
        if sketches is None:
            sketches = written(texts.join(left.select("doc").distinct(), "doc", "left_semi").mapInPandas(sketch, "doc long, total double, cells binary"), "sketches")
        best = turn < BEST_ROUNDS

        def partners(batches, best=best):
            yield from _meet(batches, threshold, best)

        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        dealt = left.withColumn("own", F.pmod(F.xxhash64("doc", F.lit(turn)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "doc", "comp")
        keys = ["bucket", "low", "high"]
        grouped = dealt.join(sketches, "doc").select(*keys, "side", "doc", "comp", "total", "cells").repartition(*keys).sortWithinPartitions(*keys)
        found = grouped.mapInPandas(partners, "a long, b long").distinct().join(scored.select("a", "b"), ["a", "b"], "left_anti")
        new = score(written(found, "candidates").select(F.col("a").alias("leader"), F.col("b").alias("doc")))
        scored = scored.unionByName(new)
    return scored.filter(F.col("similarity") >= threshold)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) for every row: the class's smallest doc_id, and the verified
    links of the row's text."""
    return _classes(docs, threshold).select("doc_id", "class_id", "n_links")


def _copy(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """``classes`` with each row's ``copy`` (of its text) and ``first``: whether its text is the one
    that names its class."""
    idf = idf_table(docs)
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def sign(batches):
        yield from _signatures(batches, shared.value)

    text = F.col("text").cast("string")
    signed = written(docs.select(F.col("doc_id").cast("long"), _copy(text).alias("copy"), text.alias("text")).mapInArrow(sign, "doc_id long, copy binary, bands array<long>"), "signatures")
    # a node is a text, whatever ids its rows have; written once, its number holds
    nodes = written(signed.filter("bands is not null").groupBy("copy").agg(F.min("doc_id").alias("name"), F.first("bands").alias("bands")).withColumn("doc", F.monotonically_increasing_id()), "nodes")
    links = written(verified_links(docs, nodes.select("doc", "copy", "bands"), idf, threshold), "links")
    label = components(links)
    counts = links.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count("*").alias("n_links"))
    in_class = written(label.withColumnRenamed("node", "doc").join(nodes.select("doc", "name"), "doc").join(counts, "doc"), "linked")
    named = in_class.groupBy("label").agg(F.min(F.struct(F.col("name").isNull().alias("none"), "name", "doc")).alias("first")).select("label", "first")
    found = in_class.join(named, "label").select("doc", "n_links", F.col("first.name").alias("class_name"), (F.col("first.doc") == F.col("doc")).alias("first"))
    every = nodes.select("copy", "doc", "name").join(found, "doc", "left")
    every = every.select("copy", F.when(F.col("first").isNull(), F.col("name")).otherwise(F.col("class_name")).alias("class_name"), F.coalesce("first", F.lit(True)).alias("first"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = signed.select("doc_id", "copy", F.col("bands").isNull().alias("alone")).join(every, "copy", "left")
    return out.select("doc_id", "copy", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("class_name")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("alone") | F.col("first")).alias("first"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id and text name their class; of rows that
    repeat both, one stays."""
    found = written(_classes(docs, threshold), "classes")
    i, c, n = unused(docs, "_id", "_copy", "_n")
    kept = found.filter(F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy(F.col("doc_id").alias(i), F.col("copy").alias(c)).agg(F.count("*").alias(n))
    rows = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept[i]) & _copy(docs["text"].cast("string")).eqNullSafe(kept[c]))
    once = rows.filter(F.col(n) == 1).select(docs.columns)
    again = rows.filter(F.col(n) > 1).dropDuplicates([i, c]).select(docs.columns)
    return once.unionByName(again)
