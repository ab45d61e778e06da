from __future__ import annotations

import struct
import zlib

from pyspark.sql import functions as F

from modsieve.operators import audit
from modsieve.operators import frames as FR
from modsieve.sources import readers


def png(pixels: list[list[int]]) -> bytes:
    raw = b"".join(b"\0" + bytes(r) for r in pixels)
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_image_hashes_from_files(spark, tmp_path):
    up = [[x * 8 for x in range(32)] for _ in range(32)]
    near = [row[:] for row in up]
    near[0][0] = 255
    checker = [[255 * ((x // 4 + y // 4) % 2) for x in range(32)] for y in range(32)]
    for name, data in (("a.png", png(up)), ("b.png", png(near)), ("c.png", png(checker)), ("d.png", b"garbage")):
        (tmp_path / name).write_bytes(data)
    got = {r.f: r.hash for r in FR.hashed(readers.images(spark, str(tmp_path))).select(F.element_at(F.split("image.origin", "/"), -1).alias("f"), "hash").collect()}
    assert got["a.png"] == -1 and got["d.png"] is None  # a rising ramp sets all 64 bits
    assert bin((got["a.png"] ^ got["b.png"]) & (2**64 - 1)).count("1") <= 2
    assert bin((got["a.png"] ^ got["c.png"]) & (2**64 - 1)).count("1") > 14
    files = readers.media_files(spark, str(tmp_path), "*.png")
    assert files.count() == 4 and files.filter("length = 7").count() == 1


def greedy(hashes, t):
    kept = []
    for i, h in enumerate(hashes):
        if h is None or all(k is None or bin((k ^ h) & (2**64 - 1)).count("1") > t for _, k in kept):
            kept.append((i, h))
    return [i for i, _ in kept]


def test_dedup_is_greedy_and_idempotent(spark):
    sets = {"a": [0, 1, 3, 7, 15, None, 1], "b": [None, None], "c": [5], "d": [0, 3, 15, 255]}
    df = spark.createDataFrame([(k, i, h) for k, v in sets.items() for i, h in enumerate(v)], "asset_id string, frame_idx long, hash long")
    for t in (-1, 0, 1, 2):
        got = FR.dedup(df, t)
        by = {}
        for r in got.orderBy("frame_idx").collect():
            by.setdefault(r.asset_id, []).append(r.frame_idx)
        assert by == {k: list(range(len(v))) if t < 0 else greedy(v, t) for k, v in sets.items()}
        assert FR.dedup(got.select("asset_id", "frame_idx", "hash"), t).count() == got.count()


HEADS = "chain_id long, seq long, entry_hash string"


def chain(spark, n=6):
    rows = spark.createDataFrame([(c, i, f"2024-01-01T00:00:0{i}.000000000Z", {"job_id": f"j{c}{i}", "verdict": "allow", "note": 'a"b\\c <&>'}) for c in (1, 2) for i in range(n)], "chain_id long, ord long, timestamp string, payload map<string,string>")
    return audit.append(rows, spark.createDataFrame([], HEADS)).cache()


def test_chain_verifies_and_edits_show(spark):
    c = chain(spark)
    assert all(r.first_broken is None and r.n_valid == 6 for r in audit.verify(c).collect())
    forged = c.withColumn("payload", F.when(F.col("seq") == 4, F.create_map(F.lit("verdict"), F.lit("block"))).otherwise(F.col("payload")))
    assert {(r.first_broken, r.n_valid) for r in audit.verify(forged).collect()} == {(4, 3)}
    assert {(r.first_broken, r.n_valid) for r in audit.verify(c.filter("seq <> 3")).collect()} == {(4, 2)}
    for col in ("timestamp", "prev_hash", "entry_hash"):
        edited = c.withColumn(col, F.when(F.col("seq") == 2, F.reverse(col)).otherwise(F.col(col)))
        assert all(r.first_broken == 2 for r in audit.verify(edited).collect()), col


def test_anchor_and_append(spark):
    c = chain(spark)
    heads = audit.heads_of(c)
    assert {r.status for r in audit.anchors(c, heads).collect()} == {"ok"}
    assert {r.status for r in audit.anchors(c.filter("seq < 5"), heads).collect()} == {"truncated"}
    assert {r.status for r in audit.anchors(c, heads.withColumn("entry_hash", F.lit("0" * 64))).collect()} == {"rewritten"}
    assert {r.status for r in audit.anchors(c, heads.limit(0)).collect()} == {"unanchored"}
    more = spark.createDataFrame([(1, 9, "t", {"job_id": "new"}), (3, 9, "t", {"job_id": "new"})], "chain_id long, ord long, timestamp string, payload map<string,string>")
    longer = c.unionByName(audit.append(more, heads))
    assert {(r.chain_id, r.first_broken, r.n_valid) for r in audit.verify(longer).collect()} == {(1, None, 7), (2, None, 6), (3, None, 1)}


def test_signatures(spark):
    c = audit.signed(chain(spark), b"key")
    assert audit.bad_signatures(c, b"key").count() == 0
    assert audit.bad_signatures(c, b"other").count() == 12
    assert audit.bad_signatures(c.withColumn("signature", F.lit(None).cast("string")), b"key").count() == 12


def test_bad_audit_line_fails_and_blank_lines_do_not(spark, tmp_path):
    good = '{"chain_id":1,"seq":1,"timestamp":"t","prev_hash":"p","payload":{"a":"b"},"entry_hash":"e"}'
    (tmp_path / "ok.json").write_text(good + "\n\n" + good + "\n")
    (tmp_path / "bad.json").write_text(good + "\n{oops\n")
    assert readers.audit_log(spark, str(tmp_path / "ok.json")).count() == 2
    try:
        readers.audit_log(spark, str(tmp_path / "bad.json")).collect()
        raise AssertionError("the bad line passed")
    except Exception as e:
        assert "MALFORMED" in str(e)
    assert readers.audit_log(spark, str(tmp_path / "bad.json"), triage=True).cache().filter("_corrupt is not null").count() == 1
