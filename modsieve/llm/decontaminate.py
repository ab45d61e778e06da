"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over consecutive words: words under a 1 are hashed, words under a
0 are ignored, so a hit survives substitutions at the ignored places. Hashes of test items and
of training documents are joined; every hit gives an item, a document and an alignment, and the
alignment is then verified word by word with substitutions allowed.

The training side sends only hashes that pass a Bloom filter of the benchmark's hashes. The
filter has a fixed number of bits (2 MB), so its size does not grow with either table; what
passes it wrongly finds no partner in the join. Hits are rows, never collected.

Hits are joined under the hash and a part of ``PARTS`` that the document's region decides, so a
hash or an item that a large share of the documents holds is dealt to several tasks.

Defined cases: a null or empty text has no words and matches nothing; an item of fewer than
``MIN_WORDS`` words matches documents that have exactly its words and no others; items of fewer
than ``FULL`` words get masks of their length that leave out every set of places the allowed
substitutions can fall on; very long texts are searched whole; of overlaps of a pair the one with
most equal words, then fewest words, then the first is reported; repeated document rows and items
give one result row for each (doc_id, item_id); a null id stays a null id; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import text_key, unused, written

MASKS = ("111001011", "1101000111", "10110010011")
MIN_WORDS = 5
PARTS = 8
#: Matching words that an overlap needs (or four words in five of the item, if that is less), and
#: the cost of one substitution in matches: a sum of 0 means that four words in five agree.
MIN_OVERLAP = 13
#: Items of so many words are found by ``MASKS``.
FULL = 16
SUBSTITUTION = 4
BLOOM_BITS = 24
_LONGEST = max(map(len, MASKS))


def needed(n: int) -> int:
    """Matching words that an item of ``n`` words needs."""
    return min(MIN_OVERLAP, -(-4 * n // 5))


def short_masks(n: int) -> tuple[str, ...]:
    """Masks of ``n`` places: whichever places the allowed substitutions take, one mask ignores them."""
    allowed = n - needed(n)
    parts = np.array_split(np.arange(n), n if allowed < 2 else allowed + 3)
    return tuple("".join("0" if any(k in parts[i] for i in out) else "1" for k in range(n)) for out in itertools.combinations(range(len(parts)), allowed))


def _tag(mask: str) -> int:
    return int("1" + mask, 2)


def _seed_hashes(h: np.ndarray, offsets: np.ndarray, mask: str, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of one mask at every place where it fits into a row, and those places."""
    m = len(h) - len(mask) + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.arange(m)
    row_end = offsets[np.searchsorted(offsets, at, side="right")]
    at = at[at + len(mask) <= row_end]
    acc = np.full(len(at), tag, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            acc = acc * np.uint64(W._BASE) + h[at + k]
    return W.mix(acc), at


def _item_rows(batches):
    for b in batches:
        raw, off = W.buffers(b.column(1))
        h, wo = W.hashes(raw, off)
        ids = b.column(0).to_pylist()
        for i, item in enumerate(ids):
            own = h[wo[i] : wo[i + 1]]
            n = len(own)
            if not n:
                continue
            masks = MASKS if n >= FULL else short_masks(n)
            rows = [_seed_hashes(own, np.array([0, n]), m, _tag(m)) for m in masks]
            key = np.concatenate([x[0] for x in rows])
            pos = np.concatenate([x[1] for x in rows])
            row = uuid.uuid4().int >> 65
            yield pa.RecordBatch.from_arrays(
                [pa.array([row] * len(key), pa.int64()), pa.array([item] * len(key), pa.int64()), pa.array(key.view(np.int64)), pa.array(pos.astype(np.int32)), pa.array([W.folded(raw[off[i] : off[i + 1]])] + [None] * (len(key) - 1), pa.binary()), pa.array(np.full(len(key), n, np.int32))],
                names=["item", "item_id", "hash", "item_pos", "item_words", "item_n"],
            )


def _doc_regions(batches, bloom: np.ndarray, masks: tuple[str, ...], reach: int):
    """Regions of documents around hashes that pass the filter: their words and their hits."""
    bits = np.uint64((1 << BLOOM_BITS) - 1)
    for b in batches:
        raw_all, off_all = W.buffers(b.column(1))
        ids = b.column(0)
        for i0, i1 in W.groups(off_all):
            raw, off = raw_all[off_all[i0] : off_all[i1]], off_all[i0 : i1 + 1] - off_all[i0]
            h, wo, begin, end = W.placed(raw, off)
            if not len(h):
                continue
            found_key, found_at = [], []
            for m in masks:
                n = len(h) - len(m) + 1
                if n <= 0:
                    continue
                # hashes at all places, across rows too; what the filter lets pass is looked at again
                acc = np.full(n, _tag(m), np.uint64)
                for k, bit in enumerate(m):
                    if bit == "1":
                        acc *= np.uint64(W._BASE)
                        acc += h[k : k + n]
                key = W.mix(acc)
                low = key & bits
                at = np.flatnonzero(bloom[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
                row = np.searchsorted(wo, at, side="right") - 1
                fits = at + len(m) <= wo[row + 1]
                if len(m) < MIN_WORDS:  # such an item is a whole document or nothing
                    fits &= wo[row + 1] - wo[row] == len(m)
                found_key.append(key[at[fits]])
                found_at.append(at[fits])
            if not found_key:
                continue
            key, at = np.concatenate(found_key), np.concatenate(found_at)
            if not len(key):
                continue
            order = np.argsort(at, kind="stable")
            key, at = key[order], at[order]
            row = np.searchsorted(wo, at, side="right") - 1
            new = np.ones(len(at), bool)
            new[1:] = (row[1:] != row[:-1]) | (np.diff(at) > 2 * reach)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            doc, uid, start, words, hashes, places = [], [], [], [], [], []
            for f, l in zip(first.tolist(), last.tolist(), strict=True):
                r = int(row[f])
                lo, hi = max(int(wo[r]), int(at[f]) - reach), min(int(wo[r + 1]), int(at[l]) + reach + _LONGEST)
                doc.append(ids[i0 + r].as_py())
                uid.append(uuid.uuid4().int >> 65)
                start.append(lo - int(wo[r]))
                words.append(W.folded(raw[begin[lo] : end[hi - 1]]))
                hashes.append(key[f : l + 1].view(np.int64))
                places.append((at[f : l + 1] - lo).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.string()), pa.array(uid, pa.int64()), pa.array(start, pa.int64()), pa.array(words, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                names=["doc", "region", "start", "words", "hashes", "places"],
            )


def _longest_overlap(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, length and matches of the segment with the most matches of those in which four words in five agree."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -SUBSTITUTION))])
    matches = np.concatenate([[0], np.cumsum(equal)])
    # the last end at which a start's sum is not negative: later ends only add matches
    later = np.maximum.accumulate(total[::-1])
    end = len(total) - 1 - np.searchsorted(later, total)
    start = int(np.argmax(matches[end] - matches))
    inside = np.flatnonzero(equal[start : end[start]])
    if not len(inside):
        return 0, 0, 0
    return start + int(inside[0]), int(inside[-1] - inside[0] + 1), len(inside)


def _verify(batches):
    known: tuple[bytes, list[bytes]] = (b"", [])
    for pdf in batches:
        out = []
        for doc, item, start, words, item_words, diagonal in zip(pdf.doc, pdf.item_id, pdf.start, pdf.words, pdf.item_words, pdf.diagonal, strict=True):
            if words is not known[0]:
                known = (words, words.split())
            d, t = known[1], item_words.split()
            lo, hi = max(0, -diagonal), min(len(t), len(d) - diagonal)
            if hi <= lo or len(t) < MIN_WORDS and (start, len(d)) != (0, len(t)):
                continue
            s, n, same = _longest_overlap(np.array([x == y for x, y in zip(d[lo + diagonal : hi + diagonal], t[lo:hi], strict=True)]))
            if same >= needed(len(t)):
                out.append((doc, item, int(start + diagonal + lo + s), lo + s, n, same))
        yield pd.DataFrame(out, columns=["doc", "item_id", "doc_start", "item_start", "n_words", "n_same"]).astype({"item_id": "Int64"})


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and test item that overlap: (doc_id, item_id, doc_start,
    item_start, n_words, n_same), positions and lengths in words, the best overlap of each pair."""
    found = _overlaps(docs.select(F.col("doc_id").cast("long").cast("string").alias("doc"), F.col("text").cast("string").alias("text")), benchmark)
    return found.select(F.col("doc").cast("long").alias("doc_id"), "item_id", "doc_start", "item_start", "n_words", "n_same")


def _overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contaminated`` for documents (doc, text) named by any text."""
    spark = docs.sparkSession
    schema = "item long, item_id long, hash long, item_pos int, item_words binary, item_n int"
    items = written(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(_item_rows, schema), "seeds")
    # a fixed number of bits: at most 2**(BLOOM_BITS - 5) rows, whatever the benchmark's size
    low = F.col("hash").bitwiseAND((1 << BLOOM_BITS) - 1)
    bits = items.select(F.shiftright(low, 5).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(31).cast("int")).alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect()
    cells = np.zeros(1 << (BLOOM_BITS - 5), np.uint32)
    for x in bits:
        cells[x.cell] = x.bits
    bloom = spark.sparkContext.broadcast(cells.view(np.uint8))
    facts = items.agg(F.max("item_n").alias("longest"), F.array_sort(F.collect_set(F.when(F.col("item_n") < FULL, F.col("item_n")))).alias("short")).first()
    masks, reach = (*MASKS, *(m for n in facts.short for m in short_masks(n))), (facts.longest or 0) + 1

    def regions_of(batches):
        yield from _doc_regions(batches, bloom.value, masks, reach)

    regions = written(docs.mapInArrow(regions_of, "doc string, region long, start long, words binary, hashes array<long>, places array<int>"), "regions")
    part = F.pmod(F.xxhash64("region"), F.lit(PARTS)).cast("int").alias("part")
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    hits = regions.select("region", part, F.explode(F.arrays_zip("hashes", "places")).alias("x")).select("region", "part", F.col("x.hashes").alias("hash"), F.col("x.places").alias("place"))
    pairs = hits.join(items.select("item", "hash", "item_pos", parts), ["hash", "part"]).select("region", "part", "item", (F.col("place") - F.col("item_pos")).alias("diagonal")).distinct()
    # rows of the benchmark meet by a key of their own, so null and repeated ids do no harm
    texts = items.filter("item_words is not null").select("item", "item_id", "item_words", parts)
    aligned = pairs.join(regions.select("region", "doc", "start", "words"), "region").join(texts, ["item", "part"]).select("doc", "item_id", "start", "words", "item_words", "diagonal")
    checked = aligned.mapInPandas(_verify, "doc string, item_id long, doc_start long, item_start long, n_words long, n_same long")
    return checked.groupBy("doc", "item_id").agg(F.max(F.struct("n_same", -F.col("n_words"), -F.col("doc_start"), -F.col("item_start"))).alias("b")).select(
        "doc", "item_id", (-F.col("b.col3")).alias("doc_start"), (-F.col("b.col4")).alias("item_start"), (-F.col("b.col2")).alias("n_words"), F.col("b.n_same").alias("n_same")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that overlap with no test item. Rows are matched by doc_id
    and the SHA-256 of the text, so null and repeated ids do no harm."""
    key, (name,) = text_key(docs["doc_id"], docs["text"]), unused(docs, "_key")
    found = _overlaps(docs.select(key.alias("doc"), docs["text"].cast("string").alias("text")), benchmark).select(F.col("doc").alias(name)).distinct()
    return docs.join(found, key == F.col(name), "left_anti")
