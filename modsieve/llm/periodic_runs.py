"""Periodic runs of words by suffix trees: longest common extensions and Lyndon roots.

A run is a stretch of consecutive words with a smallest period q, of four periods and six words at
least, that no neighbouring word extends. For each document Ukkonen's algorithm builds the suffix
tree of its words and that of their reversal. An Euler tour of a tree, reduced to the string depth
of the lowest node between consecutive leaves, with a sparse table of minima gives the lowest common
ancestor of two leaves in constant time, and with it the longest common extension of two places, to
the right by one tree and to the left by the other. Every run has a Lyndon root: the longest Lyndon word that starts
at some place, in the order of the words or in its reverse. So each place has two candidate periods, up to
the next smaller and the next greater suffix; both extensions say how far a candidate reaches.

A word that lies in a run belongs to five words in a row that stand in the run again, a period away,
and a period is a quarter of the run at most. What no such five words cover, found by hashes over the
whole document, can't be part of a run. Each stretch of such words is one symbol of its own in the trees, which
therefore grow with what repeats nearby and not with the whole text. Hashes only let more through.

Defined cases: a null or empty text has no words and no runs; a document is one row, read and searched whole, whose trees take about
700 bytes for each word that repeats nearby; words are compared byte by byte; repeated rows are
searched one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Least words of a run, and its least number of periods.
LEAST, PERIODS = 6, 4
#: Words in a row that a run repeats, whatever its period: LEAST - 1.
GRAM = 5
_ROUNDS = 4
_PIECE = 1 << 20

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def suffix_tree(s: list[int]) -> tuple[dict[int, int], list[int], list[int], int]:
    """Ukkonen's suffix tree of ``s``, whose last symbol is its greatest and occurs once.

    Returns the children (node * width + symbol -> node), each node's first place on its edge and
    the place after its last (0: the end of ``s``), and the width."""
    width = max(s) + 1
    kids: dict[int, int] = {}
    first, end, link = [0], [0], [0]
    node, edge, length, waiting = 0, 0, 0, 0
    for i, c in enumerate(s):
        waiting += 1
        unlinked = 0
        while waiting:
            if not length:
                edge = i
            key = node * width + s[edge]
            child = kids.get(key)
            if child is None:
                kids[key] = len(first)
                first.append(i)
                end.append(0)
                link.append(0)
                if unlinked:
                    link[unlinked] = node
                    unlinked = 0
            else:
                a = first[child]
                span = (end[child] or i + 1) - a
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                if s[a + length] == c:
                    length += 1
                    if unlinked:
                        link[unlinked] = node
                    break
                middle = len(first)
                first += (a, i)
                end += (a + length, 0)
                link += (0, 0)
                kids[key] = middle
                kids[middle * width + c] = middle + 1
                first[child] = a + length
                kids[middle * width + s[a + length]] = child
                if unlinked:
                    link[unlinked] = middle
                unlinked = middle
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return kids, first, end, width


def euler_tour(s: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the string depth of the lowest common ancestor of each and the one before."""
    kids, first, end, width = suffix_tree(s)
    n = len(s)
    key, child = np.fromiter(kids.keys(), np.int64, len(kids)), np.fromiter(kids.values(), np.int64, len(kids))
    del kids
    order = np.argsort(key)
    parent, child = key[order] // width, child[order]
    at = np.searchsorted(parent, np.arange(len(first) + 1)).tolist()
    child = child.tolist()
    suffixes, between = [], []
    stack = [(0, 0, 0)]  # node, string depth of its parent, depth of the ancestor shared with the leaf before
    while stack:
        v, depth, shared = stack.pop()
        stop = end[v] if v else 0
        if v and not stop:
            suffixes.append(first[v] - depth)
            between.append(shared)
            continue
        depth += stop - first[v]
        a, b = at[v], at[v + 1]
        for k in range(b - 1, a, -1):
            stack.append((child[k], depth, depth))
        stack.append((child[a], depth, shared))
    assert len(suffixes) == n
    return np.array(suffixes, np.int64), np.array(between, np.int64)


class Extensions:
    """Longest common extensions to the right of two places, in constant time each."""

    def __init__(self, s: list[int]) -> None:
        suffixes, between = euler_tour(s)
        self.rank = np.empty(len(s), np.int64)
        self.rank[suffixes] = np.arange(len(s))
        self.table = [between.astype(np.int32)]
        while 2 << (len(self.table) - 1) <= len(s):
            t, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-half], t[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.zeros(len(lo), np.int64)
        for k in np.unique(level).tolist():
            m = level == k
            out[m] = np.minimum(self.table[k][lo[m]], self.table[k][hi[m] - (1 << k)])
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one with a smaller rank; the length if there is none."""
    n = len(rank)
    out, open_ = [n] * n, []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return out


def runs_of(s: list[int]) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``s``, by start and period.

    Symbols that occur once separate; the last one must be one, and the greatest."""
    n = len(s) - 1
    right = Extensions(s)
    left = Extensions(s[:n][::-1] + [s[n]])
    i = np.arange(n)
    rank = right.rank[:n]
    i = np.concatenate([i, i])
    j = np.array(_next_smaller(rank.tolist()) + _next_smaller((-rank).tolist()), np.int64)
    ok = j < n
    i, j = i[ok], j[ok]
    back = np.zeros(len(i), np.int64)
    inner = i > 0
    back[inner] = left(n - i[inner], n - j[inner])
    p = j - i
    length = back + p + right(i, j)
    ok = length >= np.maximum(LEAST, PERIODS * p)
    found = np.stack([i[ok] - back[ok], p[ok], length[ok]], axis=1)
    return np.unique(found, axis=0)[:, [0, 2, 1]]


def _stretches(on: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal stretches of true, cut where rows begin."""
    edge = np.ones(len(on) + 1, bool)
    edge[1:-1] = on[1:] != on[:-1]
    edge[row_starts] = True
    at = np.flatnonzero(edge)
    a, b = at[:-1], at[1:]
    keep = on[a]
    return a[keep], b[keep]


def nearby(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of words (first, after last) outside which no run has a word; ``offsets`` are the rows'."""
    n = len(h)
    grams, off = W.shingles(h, offsets, GRAM)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(off))
    pos = np.arange(len(grams)) - off[row] + offsets[row]
    order = np.argsort(grams, kind="stable")
    same = np.flatnonzero((grams[order][1:] == grams[order][:-1]) & (row[order][1:] == row[order][:-1]))
    far = np.iinfo(np.int64).max // 8
    after, before = np.full(len(grams), far), np.full(len(grams), far)
    gap = pos[order[same + 1]] - pos[order[same]]
    after[order[same]] = gap
    before[order[same + 1]] = gap
    some = (after < far) | (before < far)
    pos, after, before = pos[some], after[some], before[some]
    starts, ends = offsets[:-1], offsets[1:]
    starts, ends = starts[ends - starts >= LEAST], ends[ends - starts >= LEAST]
    for _ in range(_ROUNDS):
        k = np.searchsorted(starts, pos, side="right") - 1
        inside = k >= 0
        pos, after, before, k = pos[inside], after[inside], before[inside], k[inside]
        if not len(pos):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = starts[k], ends[k]
        ok = (pos + GRAM <= b) & ((PERIODS * after <= b - a) & (pos + after + GRAM <= b) | (PERIODS * before <= b - a) & (pos - before >= a))
        pos, after, before = pos[ok], after[ok], before[ok]
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, pos, 1)
        np.add.at(cover, pos + GRAM, -1)
        # stretches of an earlier round end where their last gram does
        new_a, new_b = _stretches(np.cumsum(cover)[:n] > 0, offsets[:-1][offsets[:-1] < n])
        long = new_b - new_a >= LEAST
        new_a, new_b = new_a[long], new_b[long]
        if len(new_a) == len(starts) and (new_a == starts).all() and (new_b == ends).all():
            break
        starts, ends = new_a, new_b
    return starts, ends


def document_runs(words: list[bytes], starts: list[int], ends: list[int]) -> np.ndarray:
    """Runs of one document's words that lie within the stretches."""
    ids: dict[bytes, int] = {}
    s: list[int] = []
    places: list[np.ndarray] = []
    cuts = []
    for a, b in zip(starts, ends, strict=True):
        s += [ids.setdefault(w, len(ids)) for w in words[a:b]]
        cuts.append(len(s))
        s.append(-1)
        places.append(np.arange(a, b + 1))
    for k, cut in enumerate(cuts):  # each its own, the last the greatest
        s[cut] = len(ids) + k
    found = runs_of(s)
    found[:, 0] = np.concatenate(places)[found[:, 0]]
    return found


def _kept(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    out = np.cumsum(gone)
    return [w for w, g in zip(words, out.tolist(), strict=False) if not g]


def _search(batches):
    for batch in batches:
        raw, off = W.buffers(batch.column(1))
        n = batch.num_rows
        counts, texts, sizes, found = np.zeros(n, np.int64), [], np.zeros(n + 1, np.int64), []
        for i, j in W.groups(off, _PIECE):
            h, rows, _, _ = W.placed(raw[off[i] : off[j]], off[i : j + 1] - off[i], "space")
            counts[i:j] = np.diff(rows)
            starts, ends = nearby(h, rows)
            lo = np.searchsorted(starts, rows[:-1])
            hi = np.searchsorted(starts, rows[1:])
            for k in range(j - i):
                words = raw[off[i + k] : off[i + k + 1]].tobytes().split()
                if hi[k] > lo[k]:
                    runs = document_runs(words, (starts[lo[k] : hi[k]] - rows[k]).tolist(), (ends[lo[k] : hi[k]] - rows[k]).tolist())
                    if len(runs):
                        words = _kept(words, runs)
                        found.append(runs)
                        sizes[i + k + 1] = len(runs)
                texts.append(b" ".join(words))
        every = np.concatenate(found) if found else np.empty((0, 3), np.int64)
        structs = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], names=["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), structs)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs`` (doc_id, text).

    ``runs`` are in order of start, then period; ``collapsed`` has the words joined by a space, without
    those that a run holds after its first period."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_search, SCHEMA)
