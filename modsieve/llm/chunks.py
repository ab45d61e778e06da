"""Documents packed into chunks, for operators that look up facts about parts of documents.

A chunk holds whole documents, about ``piece`` bytes of them (a longer one alone), and has a
number. Such an operator sends what it asks about, with the chunk's number, to partitions by hash,
and joins the answers to the chunks by number. The chunks are written once, in buckets of that
number, so the text itself is never shuffled.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import words as W
from .storage import shared_dir

#: Stands for a null doc_id: after all others.
LAST = np.iinfo(np.int64).max
MOST_BUCKETS = 4096


def _pack(batches, piece):
    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        raw, off = W.buffers(b.column(1))
        ids = b.column(0)
        for i, j in W.groups(off, piece):
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([ids.slice(i, j - i).to_pylist()], pa.list_(pa.int64())), pa.array([np.diff(off[i : j + 1])], pa.list_(pa.int64())), pa.array([z.compress(raw[off[i] : off[j]].tobytes())], pa.binary())],
                names=["chunk", "ids", "lengths", "z"],
            )


def packed(text: DataFrame, buckets: int, piece: int = W.PIECE) -> DataFrame:
    """(chunk, ids, lengths, z) of (doc_id, text) rows, as a bucketed table in the shared folder."""
    spark = text.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"

    def pack(batches):
        yield from _pack(batches, piece)

    rows = text.mapInArrow(pack, "chunk long, ids array<long>, lengths array<long>, z binary")
    rows.write.option("path", f"{shared_dir(spark)}/tables/{name}").option("compression", "uncompressed").bucketBy(int(max(1, min(buckets, MOST_BUCKETS))), "chunk").saveAsTable(name)
    return spark.table(name)


def unpacked(b: pa.RecordBatch):
    """(row, chunk, doc_ids with nulls last, offsets, bytes) of each row of a batch."""
    z = zstandard.ZstdDecompressor()
    at = {n: i for i, n in enumerate(b.schema.names)}
    for k in range(b.num_rows):
        ids = np.array([LAST if x is None else x for x in b.column(at["ids"])[k].as_py()], np.int64)
        off = np.concatenate([[0], np.cumsum(np.array(b.column(at["lengths"])[k].as_py(), np.int64))])
        raw = np.frombuffer(z.decompress(b.column(at["z"])[k].as_py()) if off[-1] else b"", np.uint8)
        yield k, b.column(at["chunk"])[k].as_py(), ids, off, raw
