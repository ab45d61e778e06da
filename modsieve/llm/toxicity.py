"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its distinct words
and word beginnings; the document's is the noisy-or of its sentences', 1 - prod(1 - p). Only
document labels are known, and the gradient of the noisy-or shares each label out among the
sentences, so the trained model also tells which sentences offend.

The model is fitted in numpy on at most ``SAMPLE`` labelled documents and ``SAMPLE_BYTES`` of text
of each class, chosen by hash order; class weights restore the classes' true shares. Every document is scored whole.

Defined cases: a null or empty text has no sentence and scores 0; a null label is no label; of
several labels for a document the largest holds; documents without a label are only scored; a
table without labels of both classes gives every document the score 0; a null doc_id is held out
by the remainder of the empty string; very long texts are scored whole; repeated rows are scored
alike; a score of exactly the limit is toxic; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most labelled documents of each class to train on.
SAMPLE = 3500
#: The most bytes of text of each class to train on.
SAMPLE_BYTES = 48 << 20
BITS = 18
PREFIX = 4
EPOCHS = 120
RATE = 0.3
PENALTY = 0.4
MIN_DOCS = 3
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def _ids(word: str, memo: dict[str, tuple[int, int]]) -> tuple[int, int]:
    got = memo.get(word)
    if got is None:
        if len(memo) > 500_000:
            memo.clear()
        top = (1 << BITS) - 1
        got = memo[word] = zlib.crc32(b"w" + word.encode("utf-8", "replace")) & top, zlib.crc32(b"p" + word[:PREFIX].encode("utf-8", "replace")) & top
    return got


def _features(batches):
    memo: dict[str, tuple[int, int]] = {}
    for pdf in batches:
        out = []
        for text in pdf.text:
            ids: list[int] = []
            for m in _SENTENCE.finditer((text or "").lower()):
                own = {i for w in set(_WORD.findall(m[0])) for i in _ids(w, memo)}
                if own:
                    ids.extend(sorted(own))
                    ids.append(-1)
            out.append(np.array(ids, np.int32).tobytes())
        yield pd.DataFrame({"doc_id": pdf.doc_id, "toxic": pdf.toxic, "ids": out})


def _fit(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias by proximal Adam steps on the noisy-or's log likelihood.

    The L1 penalty falls with the number of documents; features of fewer than ``MIN_DOCS``
    documents stay at zero, so that a rare word can't explain its one document's label.
    """
    n, flat = len(bags), np.concatenate(bags)
    ends = np.flatnonzero(flat == -1)
    length = np.diff(np.concatenate([[-1], ends])) - 1
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    doc_of = np.repeat(np.arange(n, dtype=np.int32), [int((b == -1).sum()) for b in bags])
    sentence_of = np.repeat(np.arange(len(length), dtype=np.int32), length)
    feature = flat[flat >= 0]
    del flat
    docs = np.zeros(1 << BITS, np.int32)
    for x in bags:
        docs[np.unique(x[x >= 0])] += 1
    seen = docs >= MIN_DOCS
    w, b, l1 = np.zeros(1 << BITS), -4.0, PENALTY / n
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    toxic, share = y[doc_of] > 0, weight[doc_of]
    for t in range(1, EPOCHS + 1):
        z = np.clip(np.add.reduceat(w.astype(np.float32)[feature], first).astype(float) + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(doc_of, -np.logaddexp(0, z), n)  # log of no offending sentence
        up = np.exp(none) / np.maximum(-np.expm1(none), 1e-9)
        g = share * np.where(toxic, up[doc_of], -1.0) * p
        gw, gb = np.bincount(feature, g.astype(np.float32)[sentence_of], len(w)) / n, g.sum() / n
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        step = RATE / (np.sqrt(v / c2) + 1e-3)
        w += step * m / c1
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0) * seen
        b += RATE * mb / c1 / (math.sqrt(vb / c2) + 1e-3)
    return w.astype(np.float32), float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float] | None:
    """The model, from labelled documents that are not held out; None without both classes."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r.toxic in (0, 1)}
    if len(share) < 2:
        return None
    few = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = few[0].unionByName(few[1])  # at most 2 * sample rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sizes = texts.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.sum("size").alias("size"))
    fits, used = [], {0: 0, 1: 0}
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # as many rows as chosen
        if used[r.toxic] + (r["size"] or 0) <= SAMPLE_BYTES:
            used[r.toxic] += r["size"] or 0
            fits.append((r.doc_id, r.toxic))
    if not fits:
        return None
    fitting = docs.sparkSession.createDataFrame(fits, "doc_id long, toxic int")
    got = texts.join(F.broadcast(fitting), "doc_id").select("doc_id", "toxic", "text").mapInPandas(_features, "doc_id long, toxic int, ids binary").toPandas()
    got = got.sort_values(["doc_id", "ids"])  # sums of floats must not depend on which task ended first
    bags = [np.frombuffer(x, np.int32) for x in got.ids]
    keep = [i for i, x in enumerate(bags) if len(x)]
    if not keep:
        return None
    y = got.toxic.to_numpy()[keep].astype(float)
    n = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    weight = np.where(y > 0, share[1] / n[1], share[0] / n[0])
    return _fit([bags[i] for i in keep], y, weight / weight.mean())


def _scorer(shared):
    """A function from a text to its score and the spans of its offending sentences."""
    memo: dict[str, tuple[float, int, float]] = {}
    w, b = shared.value if shared.value is not None else (None, 0.0)
    top = (1 << BITS) - 1

    def weights(word: str) -> tuple[float, int, float]:
        got = memo.get(word)
        if got is None:
            if len(memo) > 500_000:
                memo.clear()
            i, j = zlib.crc32(b"w" + word.encode("utf-8", "replace")) & top, zlib.crc32(b"p" + word[:PREFIX].encode("utf-8", "replace")) & top
            got = memo[word] = float(w[i]), j, float(w[j])
        return got

    def one(text: str | None) -> tuple[float, list[dict]]:
        none, found = 0.0, []
        lower = text.lower() if isinstance(text, str) else ""
        same = len(lower) == len(text or "")
        for m in _SENTENCE.finditer(lower) if w is not None else ():
            words = set(_WORD.findall(m[0]))
            if not words:
                continue
            got = [weights(x) for x in words]
            z = min(30.0, b + sum([x[0] for x in got]) + sum({x[1]: x[2] for x in got}.values()))
            none -= math.log1p(math.exp(z)) if z > -30 else 0.0
            if z >= 0:
                # the few capitals that lower to two characters move the places after them
                start, end = m.span() if same else _back(text, m.span())
                found.append({"start": start, "end": end, "score": 1 / (1 + math.exp(-z))})
        return -math.expm1(none), found

    return one


def _back(text: str, span: tuple[int, int]) -> tuple[int, int]:
    """A span of ``text.lower()`` as a span of ``text``."""
    ends = np.cumsum([len(c.lower()) for c in text])
    return int(np.searchsorted(ends, span[0], side="right")), int(np.searchsorted(ends, span[1], side="left")) + 1


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """(doc_id, score, offending): ``offending`` has the code-point spans and scores of the
    sentences that are likelier toxic than not."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats

    def scored(batches):
        one = _scorer(shared)
        for pdf in batches:
            got = [one(t) for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "score": [x[0] for x in got], "offending": [x[1] for x in got]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(scored, "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>")


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, float] | None, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``limit``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = _scorer(shared)
        for texts in batches:
            yield pd.Series([one(t)[0] for t in texts])

    return docs.filter(score_of(F.col("text").cast("string")) < limit)
