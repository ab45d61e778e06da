"""Suffix array, near-duplicates, neighbours, language model and pipeline against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from modsieve.llm import language_model, near_duplicates, neighbours, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n: int, g: random.Random) -> str:
    return " ".join("".join(g.choice("abcdefghijklmnop") for _ in range(g.randint(1, 6))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], DOCS)


# --- suffix array


def removed(rows):
    least: dict[bytes, int] = {}
    key = lambda i: 1 << 62 if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            least[s] = min(least.get(s, 1 << 62), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < key(i):
                gone[k : k + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.view(np.int8), [0]])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("frequent", [256, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 1 << 14)
    g = random.Random(frequent)
    shared = [prose(g.randint(8, 60), g) for _ in range(6)]
    rows = [(i, " ".join(g.choice(shared) if g.random() < 0.4 else prose(g.randint(3, 40), g) for _ in range(g.randint(1, 6)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "x" * 49), (203, "ab" * 400), (204, "ab" * 300), (205, "a" * 5000), (206, "a" * 60), (7, rows[7][1]), (None, rows[3][1]), (None, "q" * 80), (208, "é" * 40), (209, "é" * 41), (210, rows[5][1][:51]), (211, shared[0] + prose(30000, g) + shared[1])]
    g.shuffle(rows)
    got = suffix_dedup.removed_repeats(frame(spark, rows).withColumn("chunk", F.lit(1)).repartition(5)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == removed(rows)


def test_construction_orders_suffixes():
    g = np.random.default_rng(4)
    n = 60
    text = g.integers(97, 99, (n, suffix_dedup.COLUMNS)).astype(np.uint8)
    text[: n // 2] = text[n // 2 :]  # pairs of equal documents
    begin = g.integers(0, 5, n)
    end = np.full(n, suffix_dedup.COLUMNS) - g.integers(0, 10, n)
    owner = g.permutation(n)
    got = suffix_dedup.smallest_owners(text, begin, end, owner)
    for c in range(suffix_dedup.SPAN):
        for i in range(n):
            if begin[i] <= c and end[i] - c >= 50:
                same = [owner[j] for j in range(n) if begin[j] <= c and end[j] - c >= 50 and (text[i, c : c + 50] == text[j, c : c + 50]).all()]
                assert got[i, c] == min(same)


def test_no_documents(spark):
    assert suffix_dedup.removed_repeats(frame(spark, [])).count() == 0


# --- near-duplicates


def test_classes_hold_the_near_copies(spark):
    g = random.Random(9)
    rows = [(i, prose(g.randint(60, 300), g)) for i in range(80)]
    want = {}
    n = 1000
    for i in range(20):  # near copies: one word in a long text
        w = rows[i][1].split()
        w[len(w) // 2] = "zzz"
        rows.append((n, " ".join(w)))
        want[n] = i
        n += 1
    for i in range(10):
        rows.append((n, rows[i][1].upper() + "!"))
        want[n] = i
        n += 1
        rows.append((n, rows[i][1]))
        want[n] = i
        n += 1
    rows += [(2000, None), (2001, ""), (2002, "..."), (2003, ""), (2004, "two words"), (2005, "two words"), (3, rows[3][1]), (None, rows[4][1]), (None, prose(30, g)), (2006, prose(20000, g))]
    d = frame(spark, rows).withColumn("class_id", F.lit("clash")).repartition(3)
    got = near_duplicates.classes(d).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert all(by[k] == v for k, v in want.items())
    assert by[2005] == 2004 and all(by[i] == i for i in [*range(80), 2000, 2001, 2002, 2003, 2004, 2006])
    assert sorted(str(r.class_id) for r in got if r.doc_id is None) == ["4", "None"]
    kept = near_duplicates.keep_one(d)
    assert kept.columns == d.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted([*range(80), 2000, 2001, 2002, 2003, 2004, 2006]) and ids.count(None) == 1
    assert near_duplicates.classes(d.limit(0)).count() == 0


def test_repeated_ids_with_other_texts_keep_their_own_classes(spark):
    g = random.Random(21)
    a, b = prose(200, g), prose(200, g)
    near = lambda t: " ".join(["zz", *t.split()[1:]])
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (None, near(near(a)) + " q"), (None, "x y z"), (None, "x y z")]
    got = {(r.doc_id, r.class_id, r.n_links > 0) for r in near_duplicates.classes(frame(spark, rows)).collect()}
    assert got == {(1, 1, True), (2, 1, True), (3, 1, True), (None, 1, True), (None, None, False)}
    kept = sorted((str(r.doc_id), r.text) for r in near_duplicates.keep_one(frame(spark, rows)).collect())
    assert kept == sorted([("1", a), ("1", b), ("None", "x y z")])


def test_pairs_equal_brute_force_on_edited_copies(spark):
    g = random.Random(31)
    texts = []
    for _ in range(40):
        base = prose(g.randint(80, 300), g).split()
        for _ in range(5):
            w = base[:]
            for _ in range(g.randint(0, max(1, len(w) // 45))):
                at = g.randrange(len(w))
                w[at : at + 1] = g.choice([[], ["q" + str(g.randrange(999))], [w[at], "more"]])
            texts.append(" ".join(w))
    d = frame(spark, list(enumerate(texts))).repartition(4)
    idf = near_duplicates.idf_table(d)
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    sets = [near_duplicates.weighted(r, np.array([0, len(r)]), idf)[:2] for r in raw]
    want = [(i, j) for j in range(len(texts)) for i in range(j) if i // 5 == j // 5 and near_duplicates.similarity(sets[i], sets[j]) >= 0.8]
    of = {r.doc_id: r.class_id for r in near_duplicates.classes(d).collect()}
    # bands of four in fourteen leave out a pair of exactly 0.8 in 1000
    assert len(want) > 100 and sum(of[i] == of[j] for i, j in want) >= 0.99 * len(want)
    assert all(of[i] // 5 == i // 5 for i in of)


def test_a_large_group_needs_no_pairs(spark):
    g = random.Random(1)
    base = prose(200, g).split()
    rows = []
    for i in range(400):
        w = base[:]
        w[g.randrange(200)] = f"q{i}"
        rows.append((i, " ".join(w)))
    got = near_duplicates.classes(frame(spark, rows).repartition(4)).collect()
    assert {r.class_id for r in got} == {0}
    assert sum(r.n_links for r in got) / 2 < 400 * 12


def linked_in_one_bucket(spark, texts):
    """Links found among texts that share one bucket alone, and all pairs of 0.8 or more."""
    d = frame(spark, list(enumerate(texts))).repartition(3)
    idf = near_duplicates.idf_table(d)
    nodes = spark.createDataFrame([(i, [7] + [1000 * i + b for b in range(1, near_duplicates.BANDS)], bytearray(hashlib.sha256(t.encode()).digest())) for i, t in enumerate(texts)], "doc long, bands array<long>, copy binary")
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    sets = [near_duplicates.weighted(r, np.array([0, len(r)]), idf)[:2] for r in raw]
    want = [(a, b) for b in range(len(texts)) for a in range(b) if near_duplicates.similarity(sets[a], sets[b]) >= 0.8]
    links = near_duplicates.verified_links(d, nodes, idf).collect()
    assert len({(r.a, r.b) for r in links}) == len(links) and {(r.a, r.b) for r in links} <= set(want)
    label = {r.node: r.label for r in near_duplicates.components(spark.createDataFrame([(r.a, r.b) for r in links] or [(-1, -1)], "a long, b long")).collect()}
    return want, label, links


def test_a_bucket_of_many_groups_loses_no_group(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    g = random.Random(12)
    texts = []
    for _ in range(25):
        base = prose(400, g).split()
        for _ in range(4):
            w = base[:]
            for _ in range(2):
                w[g.randrange(len(w))] = f"q{g.randrange(10**6)}"
            texts.append(" ".join(w))
    want, label, links = linked_in_one_bucket(spark, texts)
    assert len(want) >= 100 and all(label.get(a, a) == label.get(b, b) for a, b in want)
    assert len(links) < 8 * len(texts)


def test_a_chain_is_linked_past_its_leader(spark):
    g = random.Random(13)
    texts = []
    for _ in range(6):  # each text of a chain differs from the next by a piece; the leader fails at the second
        w = prose(400, g).split()
        for k in range(6):
            texts.append(" ".join(w))
            w[k * 40 : k * 40 + 20] = prose(20, g).split()
    want, label, _ = linked_in_one_bucket(spark, texts)
    assert {(6 * c + k, 6 * c + k + 1) for c in range(6) for k in range(5)} <= set(want) and (0, 5) not in want
    assert all(label.get(a, a) == label.get(b, b) for a, b in want)


def test_the_bound_is_above_the_similarity():
    g = np.random.default_rng(8)
    for _ in range(300):
        n = int(g.integers(1, 400))
        h = g.choice(1 << 20, 2 * n, replace=False).astype(np.uint64)
        w = np.exp2(g.integers(0, 40, 2 * n) / near_duplicates.LEVELS)
        cut = int(g.integers(0, n // 4 + 1))
        sets = [tuple(x[np.argsort(h[i])] for x in (h[i], w[i])) for i in (np.arange(n), np.arange(cut, n + cut))]
        s = near_duplicates.similarity(*sets)
        cells = [np.bincount((a % np.uint64(near_duplicates.CELL_SUMS)).astype(np.int64), weights=b, minlength=near_duplicates.CELL_SUMS).astype(np.float16).tobytes() for a, b in sets]
        group = pd.DataFrame({"doc": [1, 2], "comp": [1, 2], "side": [0, 0], "total": [b.sum() for _, b in sets], "cells": cells})
        for best in (True, False):
            assert set(near_duplicates._partners(group, s, best)) == {(1, 2)}
            assert not near_duplicates._partners(group.assign(comp=1), s, best)


def test_weighted_similarity_is_estimated_by_samples():
    g = np.random.default_rng(3)
    s = near_duplicates.Sampler()
    agree, true = [], []
    for _ in range(150):
        h = np.sort(g.integers(0, 1 << 48, 300, dtype=np.uint64))
        level = g.integers(4, 14, 300)
        cut = int(g.integers(0, 150))
        a, b = (h[cut:], level[cut:]), (h[: 300 - cut // 2], level[: 300 - cut // 2])
        true.append(near_duplicates.similarity((a[0], np.exp2(a[1] / near_duplicates.LEVELS)), (b[0], np.exp2(b[1] / near_duplicates.LEVELS))))
        agree.append((s(*a) == s(*b)).mean())
    assert abs(np.mean(agree) - np.mean(true)) < 0.03


def test_components(spark):
    g = random.Random(2)
    edges = [(g.randrange(300), g.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.label for r in near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e}


# --- neighbours


def test_hilbert_curve_visits_neighbours():
    side = np.arange(16)
    cells = np.array(np.meshgrid(side, side)).reshape(2, -1).T
    keys = neighbours.hilbert_keys(cells, 4)
    assert sorted(keys) == list(range(256))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_recall_and_exact_scores(spark):
    g = np.random.default_rng(5)
    centre = g.normal(size=(12, 16))
    x = (centre[g.integers(0, 12, 1500)] + 0.3 * g.normal(size=(1500, 16))) * g.uniform(0.5, 2, (1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0] * 3), (None, x[0].tolist())] + [(3000 + i, x[20].tolist()) for i in range(60)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = neighbours.nearest(d, F.col("vec_id") % 20 == 0, 10).collect()
    ids = np.array([*range(1500), *range(3000, 3060)])
    v = np.vstack([x, np.repeat(x[20:21], 60, axis=0)])
    found = collections.defaultdict(dict)
    for r in got:
        found[r.query_id][r.rank] = (r.vec_id, r.score)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        s[q] = -np.inf
        top = np.argsort(-s, kind="stable")[:10]
        mine = found[ids[q]]
        assert sorted(mine) == list(range(1, 11)) and all(abs(sc - v[list(ids).index(i)] @ v[q]) < 1e-9 for i, sc in mine.values())
        hits += len({i for i, _ in mine.values()} & set(ids[top].tolist()))
        total += 10
    assert hits / total >= 0.9
    assert [i for _, (i, _) in sorted(found[3000].items())][:1] == [20] or found[3000][1][1] > v[20] @ v[20]
    few = neighbours.nearest(d.filter("vec_id < 3"), F.col("vec_id") == 0, 10).collect()
    assert len(few) == 2
    assert neighbours.nearest(d.limit(0), F.col("vec_id") == 0).count() == 0


def test_clustered_vectors_need_few_comparisons():
    g = np.random.default_rng(6)
    centre = g.normal(size=(60, 32))
    x = centre[g.integers(0, 60, 4000)] + 0.15 * g.normal(size=(4000, 32))
    longest = float(np.sqrt((x * x).sum(axis=1).max()))
    plan = neighbours.make_plan(x, longest)
    asked = x[:: 4000 // 100][:100]
    score = asked @ x.T
    score[np.arange(100), np.arange(0, 4000, 40)] = -np.inf
    true = x[np.argsort(-score, axis=1)[:, :20]]
    assert neighbours.fit_windows(plan, asked, true, longest)[1] <= 0.25
    noise = g.normal(size=(4000, 32))
    assert neighbours.fit_windows(plan, asked, noise[g.integers(0, 4000, (100, 20))], longest)[1] <= 1.0


def test_repeated_ids_are_separate_rows(spark):
    g = np.random.default_rng(7)
    x = g.normal(size=(60, 8)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[3].tolist()), (20, x[4].tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = collections.Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in neighbours.nearest(d, F.col("vec_id") == 20, 5).collect())
    want = collections.Counter()
    for i, (q, v) in enumerate(rows):
        if q == 20:
            near = sorted((-round(float(np.dot(v, w)), 9), j) for k, (j, w) in enumerate(rows) if k != i)[:5]
            want.update((20, n + 1, j, -s) for n, (s, j) in enumerate(near))
    assert got == want


# --- language model


def test_counts_and_base_scores(spark):
    g = random.Random(4)
    words = [f"W{i}" for i in range(400)]
    rows = [(i, " ".join(words[min(399, int(g.expovariate(0.02)))] + g.choice(["", ",", "\t"]) for _ in range(g.randint(1, 80)))) for i in range(300)]
    rows += [(900, None), (901, ""), (None, "w1 w2"), (5, rows[5][1]), (902, "\x00 é É\x0bK w1"), (903, "w1 " * 30000)]
    fold = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold)), None]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c = collections.Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, held(i), len(split(t)), sum(c[w] > 0 for w in split(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(t)), 4)) for i, t in rows)
    got = language_model.score(frame(spark, rows).withColumn("chunk", F.lit(1)).repartition(3)).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got if r.n_tokens > 1)


def test_model_learns_order_and_is_normalised(spark):
    g = random.Random(6)
    rows = [(i, " ".join(["a b c d e f".split()[(g.randrange(6) + k) % 6] if k % 6 == 0 else "" for k in range(1)] + ["red green blue " * g.randint(3, 9)])) for i in range(300)]
    got = language_model.score(frame(spark, rows)).collect()
    test = [r for r in got if r.held_out]
    assert sum(r.score for r in test) > 0.6 * sum(r.base_score for r in test)
    assert language_model.score(frame(spark, [])).count() == 0


def test_probabilities_are_normalised():
    g = np.random.default_rng(5)
    classes = language_model.Classes([(int(h), int(n)) for h, n in zip(g.integers(-(1 << 62), 1 << 62, 90), g.integers(5, 900, 90), strict=True)], [(k, 1000, 40) for k in range(language_model.TAILS)])
    w = g.integers(0, classes.n, (6000, language_model.CONTEXTS))
    q = language_model.train(language_model.start(classes), w, (w[:, 0] * 7 + 1) % classes.n, classes, 1, 0.02, False)
    mapped = [q["context"] @ m for m in q["maps"]]
    every = np.arange(classes.n)
    for row in w[:3]:
        assert abs((10 ** language_model.log_probability(q, mapped, np.repeat(row[None], classes.n, axis=0), every, classes)).sum() - 1) < 1e-6


def test_tail_words_share_their_class(spark):
    raw = np.frombuffer(b"Station nation ab \xc3\xa9b b", np.uint8)
    t, to = language_model.tokens(raw, np.array([0, len(raw)]))
    tail = t & np.uint64(language_model.TAILS - 1)
    assert list(to) == [0, 6] and len(set(t.tolist())) == 6 and tail[0] == tail[1] and t[5] == language_model.END


def test_every_training_token_trains_all_parameters(spark, monkeypatch):
    """Each training document is in one round, a round moves every kind of parameter, and neither order nor
    numbers of chunks change the result."""
    g = random.Random(9)
    rows = [(i, " ".join(g.choices(["red", "green", "blue", "grey"], k=30))) for i in range(400)]
    bounds = [language_model._bounds(r) for r in range(len(language_model.ROUNDS))]
    assert bounds[0][0] == 0 and bounds[-1][1] == 1 << 64 and all(a[1] == b[0] for a, b in itertools.pairwise(bounds))
    packed = language_model.chunks.packed(frame(spark, rows).select("doc_id", "text").repartition(1), 1)
    batches = packed.toArrow().to_batches()
    classes = language_model.Classes([(7, 5)], [(k, 1000, 40) for k in range(language_model.TAILS)])
    first = language_model.start(classes)
    seen = []
    train = language_model.train
    monkeypatch.setattr(language_model, "train", lambda q, w, c, *a: (seen.append(len(c)), train(q, w, c, *a))[1])
    for r in range(len(bounds)):
        got = list(language_model._trained(batches, classes, first, r, 1))
        moved = np.concatenate([np.frombuffer(x, np.int64) / (n * language_model.UNIT) for b in got for x, n in zip(b.column("sums").to_pylist(), b.column("weight").to_pylist(), strict=True)])
        parts = np.split(moved, np.cumsum([x.size for x in first.values()])[:-1])
        assert all(np.abs(x - first[k].ravel()).max() > 1e-3 for k, x in zip(first, parts, strict=True))
    assert sum(seen) == 31 * sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in range(400))
    monkeypatch.undo()
    one, two = ({r.doc_id: r.score for r in language_model.score(frame(spark, rows).repartition(3, "doc_id")).collect()} for _ in range(2))
    assert one == two


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    g = random.Random(8)
    docs = [(i, prose(120, g)) for i in range(60)]
    docs += [(100 + i, prose(60, g) + f". you vileword {prose(5, g)}. " + prose(60, g)) for i in range(40)]
    item = prose(30, g)
    docs += [(200, docs[0][1]), (201, docs[1][1] + " x"), (202, prose(80, g) + " " + item + " " + prose(40, g)), (203, prose(50, g) + " token=abcdef0123456789 " + prose(50, g))]
    frame(spark, docs).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(100 <= i < 140)) for i, _ in docs], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, current, str(tmp_path))
        assert out.columns == current.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        current = spark.read.parquet(path)
        seen.append({r.doc_id for r in current.collect()})
    assert not {i for i in seen[0] if 100 <= i < 140} and set(range(60)) <= seen[0]
    assert seen[0] - seen[1] == {200, 201} and seen[1] - seen[2] == {202} and seen[2] == seen[3]
    assert "[SECRET]" in current.filter("doc_id = 203").first().text
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} <= seen[3] and len(rows) > 40


CLASH = ("_key", "_KEY2", "_id", "_copy", "_n", "_spans", "_new", "doc", "item_id", "toxic", "copy", "bands", "label", "spans", "uid", "pass", "block", "score", "class_id")


def test_stages_handle_odd_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    g = random.Random(18)
    plain = [(i, prose(70, g)) for i in range(30)]
    long = prose(20000, g)
    item = prose(40, g)
    odd = [(None, None), (None, ""), (40, None), (40, None), (41, ""), (41, ""), (None, prose(50, g)), (42, long), (43, long), (44, "one"), (45, "one"), (46, plain[3][1] + " " + item), (47, "user=bob password=hunterhunter"), (47, "user=bob password=hunterhunter"), (48, "vileword " * 3), (5, prose(60, g))]
    rows = [(i, t, g.choice([None, "en"]), g.choice([None, "s"]), None) for i, t in plain + odd]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in CLASH}).repartition(3)
    labels = [(i, 1, 0) for i in range(30)] + [(48, 0, 1), (None, 1, 1), (3, None, None), (48, 1, 0)] + [(1000 + i, 0, 1) for i in range(9)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit(1)).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (1, None), (None, ""), (2, "two words")], "item_id long, text string").withColumn("doc_id", F.lit(1)).write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    bag = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    every = bag(docs)
    for name in list(stage)[:-1]:
        out = stage[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
        got = bag(out)
        if name == "toxicity":
            assert not got - every and all(got[i, t] for i, t in plain)
        elif name == "near_duplicates":
            want = {(i, t) for i, t in every if (i, t) not in {(43, long), (45, "one"), (46, None)}}
            assert set(got) == want and max(got.values()) == 1
        elif name == "decontamination":
            assert got == collections.Counter({k: n for k, n in every.items() if k[0] != 46})
        else:
            assert got[47, "[SECRET] [SECRET]"] == 2 and sum(got.values()) == len(rows) and got[42, long] == 1
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in mixed} and all(r.n_tokens >= 0 for r in mixed)
    nothing = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, nothing, str(tmp_path)).count() == 0
    for t in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).limit(0).write.parquet(str(tmp_path / "empty" / f"{t}.parquet"))
    assert bag(stage["toxicity"](spark, docs, str(tmp_path / "empty"))) == every
    assert bag(stage["decontamination"](spark, docs, str(tmp_path / "empty"))) == every


@pytest.mark.parametrize("distinct, copies, size", [(40, 30, 16), (3, 133, 16), (300, 10, 16), (25, 1, 4), (5, 2, 4)])
def test_every_query_of_many_copies_gets_its_rows(spark, distinct, copies, size):
    g = np.random.default_rng(3)
    base = g.normal(size=(distinct, size))
    base /= np.linalg.norm(base, axis=1)[:, None]
    x = np.repeat(base, copies, axis=0).astype(np.float32).astype(float)
    d = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    rows = neighbours.nearest(d, F.col("vec_id") % 20 == 0).collect()
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    asked = range(0, len(x), 20)
    k = min(20, len(x) - 1)
    assert set(got) == set(asked) and all(len(v) == k for v in got.values())
    hit = 0
    for q in asked:
        score = x @ x[q]
        order = [int(j) for j in np.lexsort((np.arange(len(x)), -score.round(12))) if j != q][:k]
        assert [v for v, _ in got[q]] == sorted((v for v, _ in got[q]), key=lambda v: (-score[v].round(12), v)) and q not in dict(got[q])
        assert all(abs(s - score[v]) < 1e-12 for v, s in got[q])
        hit += len({v for v, _ in got[q]} & set(order))
    assert hit >= 0.9 * k * len(asked)
    if distinct <= 21:
        assert hit == k * len(asked)
