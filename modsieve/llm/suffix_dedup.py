"""Removal of repeated byte strings with a collection suffix array, built column by column.

A string of ``LENGTH`` bytes goes from a document if a document with a smaller doc_id has it too.

Partition. Among the ``GRAM``-byte grams of a window of ``LENGTH`` bytes, the one with the
smallest hash (the leftmost of equals) is its anchor. Equal windows have equal anchors, so windows
are grouped by anchor: a run of neighbouring windows with one anchor is a *segment* of at most
2 * LENGTH - GRAM bytes, and Spark shuffles segments by their anchor's hash. Anchors that no two
documents share are found first, from hashes alone, and their segments are not sent. Segments of
very frequent anchors are sent window by window under a hash of the whole window, so that one
frequent gram doesn't gather a large share of the text in one task.

Construction. Within a partition the distinct segments are a collection of short documents, laid
out by their anchors. One round for each column, from the last to the first, inserts one symbol
of each document: the suffixes that start at a column are the suffixes of the column after it,
stably partitioned by the new symbol, and the common prefix of two neighbours is one more than
the least common prefix between them before. Suffixes that start in different columns never tie,
as their anchors lie at different distances, so each column is a section of the collection's
Burrows-Wheeler transform on its own. A round reads the section before (order, symbols, common
prefixes) from one external file and appends its own to another, both in sequence. Neighbours
with a common prefix of ``LENGTH`` or more are equal windows; the smallest doc_id among them is
what each of them is judged by.

Defined cases: null and empty texts have no bytes; documents with equal doc_ids don't remove from
each other; a null doc_id counts as larger than all, and so does 2 ** 63 - 1; repeated rows are
separate documents; very long texts are chunks of their own and treated whole; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from . import words as W
from .storage import written

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1
COLUMNS = SPAN - 1 + LENGTH
#: Anchors found in so many chunks are sent window by window.
FREQUENT = 4096
#: Bytes of text for each partition of the two shuffles.
PART_BYTES = 6 << 20
_LOW = np.uint64((1 << 40) - 1)


def _leftmost(h: np.ndarray, first: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For windows that start at ``first``, the first place of their least hash."""
    out = np.empty(len(first), np.int64)
    for k in range(0, len(first), 1 << 15):
        f = first[k : k + (1 << 15)]
        out[k : k + (1 << 15)] = f + (h[f[:, None] + np.arange(SPAN)] == least[k : k + (1 << 15), None]).argmax(axis=1)
    return out


def segments(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first window, windows, anchor's place, anchor's hash,
    document; and the prefix hashes of the bytes."""
    n = len(raw)
    empty = np.empty(0, np.int64)
    up, down = W.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(W._VALUE[raw] * up[:n], out=total[1:])
    if n < LENGTH:
        return empty, empty, empty, empty.astype(np.uint64), empty, total
    h = W.mix((total[GRAM:] - total[: n + 1 - GRAM]) * down[: n + 1 - GRAM])
    low, width = h, 1
    while width * 2 <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    m = n - LENGTH + 1
    low = np.minimum(low[:m], low[SPAN - width : SPAN - width + m])
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[:m]
    inside = off[doc + 1] - np.arange(m) >= LENGTH
    new = np.ones(m, bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    new |= ~inside
    first = np.flatnonzero(new)
    last = np.append(first[1:], m) - 1
    keep = inside[first]
    # a run ends where windows that leave the document begin
    first, last = first[keep], last[keep]
    anchor = _leftmost(h, first, low[first])
    slid = last > anchor  # the anchor leaves the window, an equal gram follows
    if slid.any():
        count = (last - first + 1)[slid]
        start = np.repeat(first[slid] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        own = _leftmost(h, start, low[start])
        head = np.ones(len(start), bool)
        head[1:] = (own[1:] != own[:-1]) | (np.diff(start) != 1)
        at = np.flatnonzero(head)
        f, l = start[at], start[np.append(at[1:], len(start)) - 1]
        first, last, anchor = np.concatenate([first[~slid], f]), np.concatenate([last[~slid], l]), np.concatenate([anchor[~slid], own[at]])
    return first, last - first + 1, anchor, h[anchor], doc[first], total


def _keys(h: np.ndarray, parts: int) -> np.ndarray:
    """Partition and 40 further bits of a hash in one number, in this order."""
    return ((h >> np.uint64(44)) % np.uint64(parts) << np.uint64(40)) | (h & _LOW)


def _steps(x: np.ndarray) -> bytes:
    """Differences of neighbours, which compress well for rising numbers."""
    return np.diff(x, prepend=0).astype(np.int32).tobytes()


def _anchors(batches, parts):
    """The distinct anchors of a chunk for each partition: (part, chunk, low, high, many)."""
    for b in batches:
        for _, chunk, ids, off, raw in chunks.unpacked(b):
            _, _, _, h, doc, _ = segments(raw, off)
            key = _keys(h, parts)
            order = np.argsort(key)
            key = key[order]
            if not len(key):
                continue
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            own = ids[doc[order]]
            many = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
            key = key[first]
            part = (key >> np.uint64(40)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends = np.append(cut[1:], len(part))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[cut].astype(np.int32)),
                    pa.array(np.full(len(cut), chunk, np.int64)),
                    pa.array([key[s:e].astype(np.uint32).tobytes() for s, e in zip(cut, ends, strict=True)], pa.binary()),
                    pa.array([(key[s:e] >> np.uint64(32)).astype(np.uint8).tobytes() for s, e in zip(cut, ends, strict=True)], pa.binary()),
                    pa.array([np.packbits(many[s:e]).tobytes() for s, e in zip(cut, ends, strict=True)], pa.binary()),
                ],
                names=["part", "chunk", "low", "high", "many"],
            )


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which anchors of each chunk other documents have too, and which are frequent, as bits."""
    low = [np.frombuffer(x, np.uint32) for x in pdf.low]
    size = np.array([len(x) for x in low])
    key = np.concatenate(low).astype(np.uint64) | (np.concatenate([np.frombuffer(x, np.uint8) for x in pdf.high]).astype(np.uint64) << np.uint64(32))
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(pdf.many, size, strict=True)]).astype(bool)
    order = np.argsort(key)
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    count = np.diff(np.append(first, len(key)))
    hit = (count > 1) | np.logical_or.reduceat(many[order], first)
    shared, often = np.empty(len(key), bool), np.empty(len(key), bool)
    shared[order], often[order] = np.repeat(hit, count), np.repeat(count >= FREQUENT, count)
    ends = np.cumsum(size)
    pack = lambda bits: [np.packbits(bits[e - n : e]).tobytes() for e, n in zip(ends, size, strict=True)]
    return pd.DataFrame({"part": pdf.part, "chunk": pdf.chunk, "shared": pack(shared), "often": pack(often)})


def _sent(batches, parts):
    """The segments of shared anchors: one row for each chunk and partition, equal ones once."""
    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        column = b.schema.names.index("bits")
        for k, chunk, ids, off, raw in chunks.unpacked(b):
            bits = {x["part"]: (x["shared"], x["often"]) for x in b.column(column)[k].as_py() or ()}
            first, n, anchor, h, doc, total = segments(raw, off)
            if not bits or not len(first):
                continue
            key = _keys(h, parts)
            known, back = np.unique(key, return_inverse=True)
            part = (known >> np.uint64(40)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            shared, often = (np.concatenate([np.unpackbits(np.frombuffer(bits[p][side], np.uint8), count=e - s) for p, s, e in zip(part[cut].tolist(), cut, np.append(cut[1:], len(part)), strict=True)]).astype(bool)[back] for side in (0, 1))
            plain = np.flatnonzero(shared & ~often)
            dense = np.flatnonzero(shared & often)
            each = np.repeat(dense, n[dense])
            window = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n[dense]) - n[dense], n[dense])
            start = np.concatenate([first[plain], window])
            count = np.concatenate([n[plain], np.ones(len(each), np.int64)])
            lead = start - np.concatenate([anchor[plain], anchor[each]]) + SPAN - 1
            own = np.concatenate([doc[plain], doc[each]])
            _, down = W.powers(len(raw) + 1)
            text = W.mix((total[start + count - 1 + LENGTH] - total[start]) * down[start]) + (count.astype(np.uint64) << np.uint64(5)) + lead.astype(np.uint64)
            to = np.concatenate([key[plain] >> np.uint64(40), text[len(plain) :] % np.uint64(parts)])
            order = np.lexsort((start, to))
            text, to, start, count, lead, own = text[order], to[order], start[order], count[order], lead[order], own[order]
            cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.empty(0, np.int64)
            rows = []
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(to)], strict=True):
                # equal segments once, in the order of their first places, so that all differences are small
                _, at, same = np.unique(text[s:e], return_index=True, return_inverse=True)
                rank = np.argsort(at)
                u = at[rank] + s
                which = np.empty(len(rank), np.int64)
                which[rank] = np.arange(len(rank))
                size = count[u] - 1 + LENGTH
                place = np.repeat(start[u] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                pieces = [raw[place].tobytes(), count[u].astype(np.uint8).tobytes(), lead[u].astype(np.uint8).tobytes(), _steps(which[same]), _steps(start[s:e]), ids[own[s:e]].tobytes()]
                rows.append((int(to[s]), chunk, len(u), e - s, z.compress(b"".join(pieces))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["part", "chunk", "n", "n_all", "packed"])


def _least_between(lcp: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of lcp[first..last] for each pair, by tables of powers of two."""
    length = last - first + 1
    level = np.frexp(length.astype(np.float64))[1] - 1
    out = lcp[first].copy()
    table, width = lcp, 1
    for k in range(1, int(level.max(initial=0)) + 1):
        table = np.minimum(table[:-width], table[width:])
        width *= 2
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[first[at]], table[last[at] - width + 1])
    return out


def smallest_owners(text: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray, scratch: str | None = None) -> np.ndarray:
    """Column-wise construction over anchored documents: for every document and window column the
    smallest owner of an equal window.

    ``text`` is (documents, COLUMNS) bytes, of which a document has the columns begin to end."""
    out = np.full((len(text), SPAN), chunks.LAST, np.int64)
    by_end = np.argsort(end, kind="stable")
    ends = end[by_end]
    with tempfile.TemporaryFile(dir=scratch) as before, tempfile.TemporaryFile(dir=scratch) as after:
        files = [before, after]
        m = 0
        for column in range(COLUMNS - 1, -1, -1):
            old, new = files
            old.seek(0)
            order = np.fromfile(old, np.int32, m)
            symbol = np.fromfile(old, np.uint8, m)
            lcp = np.fromfile(old, np.uint8, m)
            # documents that end here come first, with an empty suffix
            lo, hi = np.searchsorted(ends, [column + 1, column + 2])
            fresh = by_end[lo:hi].astype(np.int32)
            if m:
                lcp[0] = 0
            order = np.concatenate([fresh, order])
            symbol = np.concatenate([text[fresh, column], symbol])
            lcp = np.concatenate([np.zeros(len(fresh), np.uint8), lcp])
            place = np.flatnonzero(begin[order] <= column)
            to = place[np.argsort(symbol[place], kind="stable")]
            sym = symbol[to]
            same = np.flatnonzero(sym[1:] == sym[:-1]) + 1 if len(to) else np.empty(0, np.int64)
            grown = np.zeros(len(to), np.uint8)
            grown[same] = np.minimum(_least_between(lcp, to[same - 1] + 1, to[same]), LENGTH - 1) + 1
            order, m = order[to], len(to)
            new.seek(0)
            order.tofile(new)
            (text[order, column - 1] if column else np.zeros(m, np.uint8)).tofile(new)
            grown.tofile(new)
            new.flush()
            files.reverse()
            if column < SPAN and m:
                head = np.flatnonzero(np.concatenate([[True], grown[1:] < LENGTH]))
                out[order, column] = np.repeat(np.minimum.reduceat(owner[order], head), np.diff(np.append(head, m)))
    return out


def _removed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The removed byte ranges of each chunk, from one partition's segments."""
    z = zstandard.ZstdDecompressor()
    texts, counts, leads, owners, starts, of_all, chunk_of = [], [], [], [], [], [], []
    known = 0
    for i, (n, n_all, packed) in enumerate(zip(pdf.n, pdf.n_all, pdf.packed, strict=True)):
        data = z.decompress(packed)
        at = len(data) - n_all * 16 - n * 2
        texts.append(np.frombuffer(data, np.uint8, at))
        counts.append(np.frombuffer(data, np.uint8, n, at))
        leads.append(np.frombuffer(data, np.uint8, n, at + n))
        at += 2 * n
        of_all.append(np.cumsum(np.frombuffer(data, np.int32, n_all, at), dtype=np.int64) + known)
        starts.append(np.cumsum(np.frombuffer(data, np.int32, n_all, at + 4 * n_all), dtype=np.int64))
        owners.append(np.frombuffer(data[at + 8 * n_all :], np.int64))
        chunk_of.append(np.full(n_all, i))
        known += n
    flat, count, begin = np.concatenate(texts), np.concatenate(counts).astype(np.int64), np.concatenate(leads).astype(np.int64)
    owner, start, chunk = np.concatenate(owners), np.concatenate(starts), np.concatenate(chunk_of)
    size = count - 1 + LENGTH
    row = np.repeat(np.arange(len(size)), size)
    text = np.zeros((len(size), COLUMNS), np.uint8)
    text[row, np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(flat))] = flat
    del flat, texts, row
    # equal segments of several chunks are one document of the collection, owned by the smallest
    whole = np.concatenate([text, begin[:, None].astype(np.uint8), count[:, None].astype(np.uint8)], axis=1)
    _, first, back = np.unique(whole.view(np.dtype((np.void, whole.shape[1]))).ravel(), return_index=True, return_inverse=True)
    del whole
    of = back[np.concatenate(of_all)]
    own = np.full(len(first), chunks.LAST, np.int64)
    np.minimum.at(own, of, owner)
    least = smallest_owners(text[first], begin[first], begin[first] + size[first], own)
    del text
    out: list[list[np.ndarray]] = [[] for _ in range(4)]
    window = np.arange(SPAN)
    for k in range(0, len(of), 1 << 16):
        o = of[k : k + (1 << 16)]
        b, e = begin[first][o], begin[first][o] + count[first][o]
        gone = (least[o] < owner[k : k + (1 << 16), None]) & (window >= b[:, None]) & (window < e[:, None])
        edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        r, s = np.nonzero(edge == 1)
        _, t = np.nonzero(edge == -1)
        base = start[k : k + (1 << 16)][r] - b[r]
        for x, y in zip(out, (chunk[k : k + (1 << 16)][r], base + s, base + t - 1 + LENGTH), strict=False):
            x.append(y)
    c, s, e = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out[:3])
    order = np.lexsort((s, c))
    c, s, e = c[order], s[order], e[order]
    cut = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.empty(0, np.int64)
    ends = np.append(cut[1:], len(c))
    pack = zstandard.ZstdCompressor(level=3)
    ranges = [pack.compress(_steps(s[a:b]) + (e[a:b] - s[a:b]).astype(np.uint8).tobytes()) for a, b in zip(cut, ends, strict=True)]
    return pd.DataFrame({"chunk": pdf.chunk.to_numpy()[c[cut]], "ranges": ranges})


def _ranges(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the packed byte ranges of a chunk."""
    z = zstandard.ZstdDecompressor()
    starts, lengths = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for x in packed:
        data = z.decompress(x)
        n = len(data) // 5
        starts.append(np.cumsum(np.frombuffer(data, np.int32, n), dtype=np.int64))
        lengths.append(np.frombuffer(data, np.uint8, n, 4 * n).astype(np.int64))
    start = np.concatenate(starts)
    return start, start + np.concatenate(lengths)


def _results(batches):
    """Per document: its removed spans and what stays."""
    for b in batches:
        column = b.schema.names.index("gone")
        id_column = b.schema.names.index("ids")
        for k, _, _, off, raw in chunks.unpacked(b):
            n = len(raw)
            starts, ends = _ranges(b.column(column)[k].as_py() or [])
            gone = np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n] > 0
            rows = []
            for i, (doc, s, e) in enumerate(zip(b.column(id_column)[k].as_py(), off[:-1].tolist(), off[1:].tolist(), strict=True)):
                own = gone[s:e]
                flip = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                rows.append((doc, e - s, int(own.sum()), len(flip) // 2, hashlib.sha256(raw[s:e][~own].tobytes()).hexdigest(), flip[::2], flip[1::2]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])


def removed_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends) of every row: the maximal
    removed byte runs and the digest of the bytes that stay."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n_bytes = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(1, -(-n_bytes // PART_BYTES)))
    packed = chunks.packed(text, parts)

    def anchors(batches):
        yield from _anchors(batches, parts)

    def sent(batches):
        yield from _sent(batches, parts)

    hashes = packed.mapInArrow(anchors, "part int, chunk long, low binary, high binary, many binary")
    bits = hashes.groupBy("part").applyInPandas(_shared, "part int, chunk long, shared binary, often binary")
    buckets = min(parts, chunks.MOST_BUCKETS)  # as the chunks are, so that neither join deals them out again
    bits = bits.repartition(buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("part", "shared", "often")).alias("bits"))
    rows = packed.join(bits, "chunk").mapInArrow(sent, "part int, chunk long, n int, n_all int, packed binary")
    gone = written(rows.groupBy("part").applyInPandas(_removed, "chunk long, ranges binary"), "removed")
    gone = gone.repartition(buckets, "chunk").groupBy("chunk").agg(F.collect_list("ranges").alias("gone"))
    return packed.join(gone, "chunk", "left").mapInArrow(_results, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>")
