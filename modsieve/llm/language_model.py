"""Log-bilinear neural language model, trained in numpy by noise-contrastive estimation.

Words are runs without ASCII white space, A-Z lower-cased; every text ends with an end token. The
``TOP`` most frequent words are classes of their own, all others fall into ``TAILS`` classes by a
hash of their last three bytes. The model predicts the next class from the ``CONTEXTS`` before it:
each one's vector goes through a linear map of its place, and the sum's products with the class
vectors, plus biases, are the scores. A word of a tail class has its class's probability times its
smoothed share of the class's words.

Classes lie in groups of about the square root of their number. Scoring normalises exactly, first
over the groups and then over the classes of the right group, by batched matrix products.

Training is NCE against unigram noise on every training token, in Spark. Documents are dealt to a few
rounds by a hash of their ids. In a round each chunk trains all parameters on its documents of the
round, from the values of the round before, and the chunks' parameters are averaged by tokens. The
sums are of integers (parameters in steps of 2 ** -24), so the order of tasks changes nothing. A small
corpus is gone through several times.

Words are counted by 64-bit hashes, over all training documents. Chunks send their distinct words,
with counts, to partitions by hash and get the totals back; no vocabulary is broadcast or collected
but the ``TOP`` words.

Defined cases: a null or empty text is an end token alone; a null doc_id, and 2 ** 63 - 1, counts as the
empty string; without training documents every count is 0 and the score is the base score; very long
texts are chunks of their own and scored whole; of words of equal counts the smaller hash is the more frequent;
repeated rows count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from . import words as W
from .storage import written

TOP = 2048
TAIL_BITS = 12
TAILS = 1 << TAIL_BITS
CONTEXTS = 4
SIZE = 24
#: Of each round: its share of the documents, its rate and its batch.
ROUNDS = ((1, 0.03, 2048), (1, 0.02, 2048), (2, 0.01, 4096), (4, 0.005, 4096))
#: Tokens that a small corpus is gone through for, steps of a chunk that are enough for it.
TOKENS, STEPS = 5_000_000, 600
NOISE, GROUP_NOISE = 64, 16
UNIT, WEIGHT = 1 << 24, 1024
PIECE = 4 << 20
SLICE, ROWS = 1 << 17, 1 << 11
PART_WORDS_BYTES = 24 << 20
END = np.uint64(0x5DEECE66D1234567)
_TAIL = np.uint64(TAILS - 1)


def _crc(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i == chunks.LAST else str(i).encode()) % 5 for i in ids.tolist()], np.int64)


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row's end token included, and the rows' offsets. A hash's last
    ``TAIL_BITS`` bits are its word's tail class."""
    h, wo, start, end = W.placed(raw, off, "space")
    last = np.zeros(len(h), np.uint64)
    for k in (1, 2, 3):
        at = np.maximum(end - k, 0)
        last = last * np.uint64(257) + np.where(end - k >= start, W._SPACE[raw[at]], 0).astype(np.uint64)
    h = (h & ~_TAIL) | (W.mix(last) & _TAIL)
    n = len(off) - 1
    to = wo + np.arange(n + 1)
    out = np.empty(len(h) + n, np.uint64)
    word = np.ones(len(out), bool)
    word[to[1:] - 1] = False
    out[word], out[~word] = h, END
    return out, to


def _part(known: np.ndarray, parts: int) -> np.ndarray:
    return ((known >> np.uint64(TAIL_BITS)) % np.uint64(parts)).astype(np.int64)


def _ask(batches, parts):
    """A chunk's distinct tokens by partition: (part, chunk, n, packed hashes and counts)."""
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        for _, chunk, ids, off, raw in chunks.unpacked(b):
            t, to = tokens(raw, off)
            if not len(t):
                continue
            known, back = np.unique(t, return_inverse=True)
            count = np.bincount(back, np.repeat(_crc(ids) != 1, np.diff(to)), len(known)).astype(np.int32)
            part = _part(known, parts)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.diff(part[order], prepend=-1))
            ends = np.append(cut[1:], len(order))
            rows = [(int(part[order[s]]), chunk, int(e - s), known[order[s:e]].tobytes(), z.compress(count[order[s:e]].tobytes())) for s, e in zip(cut, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "chunk", "n", "hashes", "counts"])


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """The totals of a partition's tokens for each chunk; the partition's sums on one row."""
    un, z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    key = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf.hashes])
    own = np.concatenate([np.frombuffer(un.decompress(x), np.int32) for x in pdf.counts])
    known, back = np.unique(key, return_inverse=True)
    total = np.bincount(back, own, len(known)).astype(np.int64)
    most = np.argsort(-total, kind="stable")[:TOP]
    most = most[total[most] > 0]
    tail = (known & _TAIL).astype(np.int64)
    n, v = np.bincount(tail, total, TAILS).astype(np.int64), np.bincount(tail, total > 0, TAILS).astype(np.int64)
    ends = np.cumsum(pdf.n.to_numpy())
    out = pd.DataFrame({"part": pdf.part, "chunk": pdf.chunk, "totals": [z.compress(total[back[e - n : e]].tobytes()) for e, n in zip(ends, pdf.n, strict=True)], "top": [[] for _ in range(len(pdf))], "tails": [[] for _ in range(len(pdf))]})
    out.at[0, "top"] = [{"hash": int(h), "n": int(c)} for h, c in zip(known[most].view(np.int64), total[most], strict=True)]
    out.at[0, "tails"] = [{"tail": int(k), "n": int(n[k]), "v": int(v[k])} for k in np.flatnonzero(v)]
    return out


class Classes:
    """The classes: words of their own by hash, tails after them, and what each tail holds besides."""

    def __init__(self, top: list[tuple[int, int]], tails: list[tuple[int, int, int]]) -> None:
        pairs = sorted((np.uint64(h & (1 << 64) - 1), n) for h, n in top)
        self.hash = np.array([h for h, _ in pairs], np.uint64)
        self.tail_n, self.tail_v = np.zeros(TAILS), np.zeros(TAILS)
        for k, n, v in tails:
            self.tail_n[k], self.tail_v[k] = n, v
        self.tokens, self.words = int(self.tail_n.sum()), int(self.tail_v.sum())
        own = (self.hash & _TAIL).astype(np.int64)
        counts = np.array([n for _, n in pairs], float)
        self.tail_n -= np.bincount(own, counts, TAILS)
        self.tail_v -= np.bincount(own, minlength=TAILS)
        self.count = np.concatenate([counts, self.tail_n])
        self.n = len(self.count)
        # groups of classes of like counts; ``place`` is a class's number in order of its group
        self.width = int(np.ceil(np.sqrt(self.n)))
        self.place = np.empty(self.n, np.int64)
        self.place[np.argsort(-self.count, kind="stable")] = np.arange(self.n)
        self.groups = -(-self.n // self.width)
        share = np.empty(self.n)
        share[self.place] = self.count + 0.5
        self.share = share / share.sum()
        self.group_share = np.add.reduceat(self.share, np.arange(0, self.n, self.width))

    def of(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of every token's class, its tail or -1)."""
        tail = (t & _TAIL).astype(np.int64)
        kind = len(self.hash) + tail
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, t), len(self.hash) - 1)
            hit = self.hash[at] == t
            kind[hit], tail[hit] = at[hit], -1
        return self.place[kind], tail


def _windows(c: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """(tokens, CONTEXTS) classes before every token, the nearest first; n is before a text."""
    place = np.arange(len(c)) - np.repeat(to[:-1], np.diff(to))
    out = np.full((len(c), CONTEXTS), n, np.int64)
    for k in range(1, CONTEXTS + 1):
        at = np.flatnonzero(place >= k)
        out[at, k - 1] = c[at - k]
    return out


def _summed(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` added up by number."""
    size = values.shape[1]
    return np.bincount((row[:, None] * size + np.arange(size)).ravel(), values.ravel(), n * size).reshape(n, size).astype(np.float32)


def start(classes: Classes, seed: int = 7) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    q = {
        "context": g.normal(0, 0.1, (classes.n + 1, SIZE)), "maps": np.stack([np.eye(SIZE) / (k + 1) for k in range(CONTEXTS)]),
        "word": g.normal(0, 0.1, (classes.n, SIZE)), "bias": np.log(classes.share), "group": g.normal(0, 0.1, (classes.groups, SIZE)), "group_bias": np.log(classes.group_share),
    }
    return {k: x.astype(np.float32) for k, x in q.items()}


def _minus_logistic(x: np.ndarray) -> np.ndarray:
    """-1 / (1 + exp(-x)), in x itself."""
    np.clip(x, -30, 30, out=x)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.divide(-1, x, out=x)


def train(q: dict[str, np.ndarray], windows: np.ndarray, target: np.ndarray, classes: Classes, epochs: int, rate: float, seed: int = 3, batch: int = 4096) -> dict[str, np.ndarray]:
    """Parameters after NCE (Adam steps) on the given tokens."""
    g = np.random.default_rng(seed)
    q = {k: x.copy() for k, x in q.items()}
    m, v = ({k: np.zeros_like(x) for k, x in q.items()} for _ in range(2))
    log_noise, log_groups = (np.log(n * x).astype(np.float32) for n, x in ((NOISE, classes.share), (GROUP_NOISE, classes.group_share)))
    edges, group_edges = np.cumsum(classes.share), np.cumsum(classes.group_share)
    steps, step = epochs * -(-len(target) // batch), 0
    for _ in range(epochs):
        order = g.permutation(len(target))
        for i in range(0, len(order), batch):
            step += 1
            at = order[i : i + batch]
            w, x = target[at], windows[at]
            size = np.float32(len(at))
            each = [q["context"][x[:, k]] for k in range(CONTEXTS)]
            p = sum(e @ q["maps"][k] for k, e in enumerate(each))
            gp, grad = 0, {}
            for name, bias, own, noise, log in (
                ("word", "bias", w, np.minimum(np.searchsorted(edges, g.random(NOISE)), classes.n - 1), log_noise),
                ("group", "group_bias", w // classes.width, np.minimum(np.searchsorted(group_edges, g.random(GROUP_NOISE)), classes.groups - 1), log_groups),
            ):
                real = np.einsum("ij,ij->i", p, q[name][own]) + q[bias][own] - log[own]
                fake = p @ q[name][noise].T
                fake += q[bias][noise] - log[noise]
                up = 1 / (1 + np.exp(np.clip(real, -30, 30)))  # of the real one
                down = _minus_logistic(fake)  # of the noise
                to = np.concatenate([own, noise])
                grad[name] = _summed(to, np.concatenate([up[:, None] * p, down.T @ p]) / size, len(q[name]))
                grad[bias] = np.bincount(to, np.concatenate([up, down.sum(axis=0)]) / size, len(q[bias])).astype(np.float32)
                gp = gp + (up[:, None] * q[name][own] + down @ q[name][noise]) / size
            grad["maps"] = np.stack([e.T @ gp for e in each])
            grad["context"] = _summed(x.T.ravel(), np.concatenate([gp @ q["maps"][k].T for k in range(CONTEXTS)]), classes.n + 1)
            now = rate * (1 - step / (steps + 1))
            for k in q:
                m[k] += np.float32(0.1) * (grad[k] - m[k])
                v[k] += np.float32(0.001) * (grad[k] * grad[k] - v[k])
                q[k] += np.float32(now / (1 - 0.9**step)) * m[k] / (np.sqrt(v[k] / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    return q


def _bounds(r: int) -> tuple[int, int]:
    """The hashes of round ``r``'s documents: from, and to before."""
    shares = [s for s, _, _ in ROUNDS]
    return tuple((sum(shares[:k]) << 64) // sum(shares) for k in (r, r + 1))


def _trained(batches, classes, q, r, epochs):
    """The parameters after a round on each chunk, weighted by tokens and summed up, in integers."""
    _, rate, batch = ROUNDS[r]
    lo, hi = (np.uint64(x) for x in (_bounds(r)[0], _bounds(r)[1] - 1))
    total, weight = 0, 0
    for b in batches:
        for _, _, ids, off, raw in chunks.unpacked(b):
            h = W.mix(ids.view(np.uint64) ^ np.uint64(0x9E37))
            use = np.flatnonzero((_crc(ids) != 1) & (h >= lo) & (h <= hi))
            if not len(use):
                continue
            part = np.concatenate([raw[off[i] : off[i + 1]] for i in use])
            t, to = tokens(part, np.concatenate([[0], np.cumsum(np.diff(off)[use])]))
            c, _ = classes.of(t)
            # chunks draw noise of their own, or averages would keep it
            got = train(q, _windows(c, to, classes.n), c, classes, epochs, rate, zlib.crc32(ids.tobytes()) + r, batch)
            n = -(-len(c) // WEIGHT)
            total, weight = total + np.rint(np.concatenate([got[k].ravel() for k in q]).astype(np.float64) * UNIT).astype(np.int64) * n, weight + n
    if weight:
        cut = np.array_split(total, 64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64, dtype=np.int32)), pa.array([x.tobytes() for x in cut], pa.binary()), pa.array([weight] * 64, pa.int64())], names=["cut", "sums", "weight"])


def _added(pdf_batches):
    """Sums of equal cuts; a cut's rows stream through."""
    total: dict[int, np.ndarray] = {}
    weight: dict[int, int] = {}
    for pdf in pdf_batches:
        for k, x, n in zip(pdf.cut, pdf.sums, pdf.weight, strict=True):
            own = np.frombuffer(x, np.int64)
            total[k] = total[k] + own if k in total else own
            weight[k] = weight.get(k, 0) + n
    yield pd.DataFrame({"cut": list(total), "sums": [x.tobytes() for x in total.values()], "weight": list(weight.values())})


def fit(packed: DataFrame, classes: Classes) -> dict[str, np.ndarray]:
    """The parameters after all rounds over the training documents of the chunks."""
    q = start(classes)
    each = classes.tokens / max(1, packed.count())  # tokens of a chunk
    for r, (share, _, batch) in enumerate(ROUNDS):
        steps = max(1, each * share / sum(s for s, _, _ in ROUNDS) / batch)
        epochs = max(1, min(-(-TOKENS // classes.tokens), int(np.ceil(STEPS / len(ROUNDS) / steps))))

        def trained(batches, q=q, r=r, epochs=epochs):
            yield from _trained(batches, classes, q, r, epochs)

        schema = "cut int, sums binary, weight long"
        sums = packed.mapInArrow(trained, schema).repartition(16, "cut").mapInPandas(_added, schema).toPandas().sort_values("cut")  # 64 rows
        if len(sums):  # else no document of a small corpus is in this round
            flat = np.concatenate([np.frombuffer(x, np.int64) / (n * UNIT) for x, n in zip(sums.sums, sums.weight, strict=True)])
            cuts = np.cumsum([x.size for x in q.values()])[:-1]
            q = {k: x.reshape(q[k].shape).astype(np.float32) for k, x in zip(q, np.split(flat, cuts), strict=True)}
    return q


def log_probability(q: dict[str, np.ndarray], mapped: list[np.ndarray], windows: np.ndarray, target: np.ndarray, classes: Classes) -> np.ndarray:
    """Normalised log10 probabilities of the targets after their windows, by matrix products."""
    out = np.empty(len(target), np.float64)
    for i in range(0, len(target), SLICE):
        x, w = windows[i : i + SLICE], target[i : i + SLICE]
        p = mapped[0][x[:, 0]]
        for k in range(1, CONTEXTS):
            p += mapped[k][x[:, k]]
        group = w // classes.width
        for j in range(0, len(w), ROWS):  # few rows at once: their scores stay in the cache
            out[i + j : i + j + ROWS] = _picked(p[j : j + ROWS] @ q["group"].T + q["group_bias"], group[j : j + ROWS])
        order = np.argsort(group.astype(np.int16), kind="stable")
        cut = np.flatnonzero(np.diff(group[order], prepend=-1))
        p = p[order]
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
            lo = int(group[order[s]]) * classes.width
            hi = min(lo + classes.width, classes.n)
            for j in range(s, e, ROWS):
                at = order[j : min(j + ROWS, e)]
                out[i + at] += _picked(p[j : min(j + ROWS, e)] @ q["word"][lo:hi].T + q["bias"][lo:hi], w[at] - lo)
    return out / np.log(10)


def _picked(score: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log of one softmax entry of each row."""
    own = score[np.arange(len(at)), at]
    top = score.max()
    total = np.exp(score - top).sum(axis=1)
    if total.min() > 1e-30:
        return own - top - np.log(total)
    # rows far below the largest one each get a scale of their own
    each = score.max(axis=1)
    return own - each - np.log(np.exp(score - each[:, None]).sum(axis=1))


def _scores(batches, classes, model, parts):
    un = zstandard.ZstdDecompressor()
    if model is not None:
        mapped = [model["context"] @ model["maps"][k] for k in range(CONTEXTS)]
    n_tokens, n_words = classes.tokens, classes.words
    for b in batches:
        answers, id_column = b.schema.names.index("answers"), b.schema.names.index("ids")
        for k, _, ids, off, raw in chunks.unpacked(b):
            if not len(ids):
                continue
            t, to = tokens(raw, off)
            known, back = np.unique(t, return_inverse=True)
            order = np.argsort(_part(known, parts), kind="stable")
            got = {x["part"]: x["totals"] for x in b.column(answers)[k].as_py()}
            total = np.empty(len(known), np.int64)
            total[order] = np.concatenate([np.frombuffer(un.decompress(got[p]), np.int64) for p in sorted(got)])
            c = total[back]
            row = np.repeat(np.arange(len(ids)), np.diff(to))
            each = np.log10((c + 0.5) / (n_tokens + 0.5 * (n_words + 1)))
            base = np.bincount(row, each, len(ids))
            if model is not None:
                kind, tail = classes.of(t)
                each = log_probability(model, mapped, _windows(kind, to, classes.n), kind, classes)
                rare = np.flatnonzero(tail >= 0)
                own = tail[rare]
                each[rare] += np.log10((c[rare] + 0.5) / (classes.tail_n[own] + 0.5 * (classes.tail_v[own] + 1)))
            arrays = [pa.array(b.column(id_column)[k].as_py(), pa.int64()), pa.array(_crc(ids) == 1), pa.array(np.diff(to)), pa.array(np.bincount(row, c > 0, len(ids)).astype(np.int64)), pa.array(np.full(len(ids), n_tokens, np.int64)), pa.array(base), pa.array(np.bincount(row, each, len(ids)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row: the
    log10 probability of each text by smoothed unigrams and by the model."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n_bytes = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(1, -(-n_bytes // PART_WORDS_BYTES)))
    packed = chunks.packed(text, parts, PIECE)

    def ask(batches):
        yield from _ask(batches, parts)

    asked = packed.mapInArrow(ask, "part int, chunk long, n int, hashes binary, counts binary")
    answers = written(asked.groupBy("part").applyInPandas(_answer, "part int, chunk long, totals binary, top array<struct<hash:long,n:long>>, tails array<struct<tail:int,n:long,v:long>>"), "answers")
    best = answers.select(F.inline("top")).orderBy(F.desc("n"), "hash").limit(TOP).collect()  # TOP rows
    tails = answers.select(F.inline("tails")).groupBy("tail").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # TAILS rows
    classes = Classes([(r.hash, r.n) for r in best], [(r.tail, r.n, r.v) for r in tails])
    model = fit(packed, classes) if classes.tokens else None
    shared = spark.sparkContext.broadcast((classes, model))  # TOP + TAILS classes

    def scores(batches):
        yield from _scores(batches, *shared.value, parts)

    replies = answers.groupBy("chunk").agg(F.collect_list(F.struct("part", "totals")).alias("answers"))
    return packed.join(replies, "chunk").mapInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
