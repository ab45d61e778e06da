"""Approximate nearest neighbours by largest inner product, over shifted Hilbert curves.

Vectors get one more component that makes their lengths equal, so that the largest inner product
is the smallest distance. Each of ``CURVES`` curves projects them at random to ``DIMS`` dimensions,
shifts and quantises them and takes the place on a Hilbert curve as key. Spark range-partitions
all rows by (curve, key); a partition is a block of neighbours that knows its rows' ranks; ranks in turn are cut into cells. A query
takes the curves on which it lies farthest from the middle (there its neighbours stand apart from
other rows most), and meets on each of them the rows of a window of ranks around its own place,
cut out of the cells the window reaches. The windows' best are merged and ranked again by the
exact inner product.

How many curves a query takes and how wide the windows are is fitted: the true neighbours of at
most ``FIT`` rows are found among all rows, and of all settings that hold ``AIM`` of them the one
with the fewest comparisons is taken. The windows of one query together never hold more than all
rows: the widest setting is one window over one whole curve. Clustered vectors need a few
hundredths of all pairs. Vectors without any structure need most of them while rows are few; the
share falls as rows grow, for the neighbours then come closer. Where the windows need half of a curve or
more, all queries take one curve, and only that one is written. Every row is indexed: equal vectors are one
row of the curves, with its members, of which the ``k`` + 1 smallest ids are enough, as no other can be
among the ``k`` nearest. A window has more rows than ``k``, so every query gets ``k`` rows if there are as many.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor
do those of another length than the commonest; ties go to the smaller id; a null id takes no
part; repeated ids are separate rows: each has its own list, and meets the others as candidates;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written

CURVES = 16
DIMS = 6
BITS = 8
SAMPLE = 4096
FIT = 128
AIM = 0.93
#: Settings: curves a query takes, and the share of all rows that its windows hold together.
TAKEN = (1, 2, 4, 8)
SHARES = (0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0)
#: A share from which one curve serves all queries.
ONE_CURVE = 0.5
BLOCKS = 4
#: A curve has so many cells of ranks at least; a cell has at most so many rows, and meets so many queries at once.
CELLS = 8
BLOCK_ROWS = 1 << 16
QUERY_ROWS = 1 << 12


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of unsigned integers below 2**bits.

    Gray-code decoding axis by axis: from the top bit down, each axis exchanges or inverts the
    lower bits of the first one, then the bits are interleaved."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _full(v: np.ndarray, longest: float, stretched: bool) -> np.ndarray:
    """Vectors of length ``longest``, by one more component or, for queries, by stretching them: a
    stretched query is nearest to its largest inner products, one that is not to its like."""
    size = (v * v).sum(axis=1)
    if stretched:
        return np.column_stack([v * (longest / np.sqrt(size))[:, None], np.zeros(len(v))])
    return np.column_stack([v, np.sqrt(np.maximum(0.0, longest * longest - size))])


def curve_keys(v: np.ndarray, longest: float, plan: dict, stretched: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(CURVES, rows) keys, and how far from the middle of each curve's rows the vectors lie."""
    full = _full(v, longest, stretched)
    keys, far = [], []
    for project, low, step, middle in zip(plan["project"], plan["low"], plan["step"], plan["middle"], strict=True):
        at = full @ project
        cell = np.clip((at - low) / step, 0, (1 << BITS) - 1)
        keys.append(hilbert_keys(cell.astype(np.int64), BITS))
        far.append((((at - middle) / step) ** 2).sum(axis=1))
    return np.array(keys), np.array(far)


def make_plan(sample: np.ndarray, longest: float, seed: int = 11) -> dict:
    """Projections and shifts, and each curve's sorted keys of a bounded sample."""
    g = np.random.default_rng(seed)
    full = _full(sample, longest, False)
    d = full.shape[1]
    plan: dict = {"project": [], "low": [], "step": [], "middle": []}
    for _ in range(CURVES):
        project = np.linalg.qr(g.normal(size=(d, min(DIMS, d))))[0]
        at = full @ project
        spread = np.full(at.shape[1], max(float((at.max(axis=0) - at.min(axis=0)).max()), 1e-9))
        plan["project"].append(project)
        plan["low"].append(at.min(axis=0) - spread * g.random(project.shape[1]) * 0.25)  # the shift
        plan["step"].append(spread * 1.25 / (1 << BITS))
        plan["middle"].append(at.mean(axis=0))
    plan["keys"] = np.sort(curve_keys(sample, longest, plan)[0], axis=1)
    return plan


def fit_windows(plan: dict, asked: np.ndarray, true: np.ndarray, longest: float) -> tuple[int, float, bool, int]:
    """(curves taken, share of all rows in the windows together, whether queries are stretched, the one curve
    that all queries take or -1) with the fewest comparisons that hold AIM of the true neighbours
    (queries, neighbours, components). Rows of one key have one rank each, anywhere among its rows' ranks."""
    q, n, d = true.shape
    g = np.random.default_rng(5)

    def place(keys: np.ndarray) -> np.ndarray:
        out = []
        for own, k in zip(plan["keys"], keys, strict=True):
            low, high = np.searchsorted(own, k), np.searchsorted(own, k, side="right")
            out.append((low + g.random(len(k)) * (high - low)) / len(own))
        return np.array(out)

    at = place(curve_keys(true.reshape(q * n, d), longest, plan)[0]).reshape(CURVES, q, n)
    ways = []
    for stretched in (False, True):
        keys, far = curve_keys(asked, longest, plan, stretched)
        ways.append((stretched, place(keys), np.argsort(-far, axis=0, kind="stable")))
    for share in SHARES[:-1]:
        for taken in TAKEN:
            half = share / taken / 2
            for stretched, own, best in ways:
                low = np.clip(own - half, 0, 1 - 2 * half)
                inside = (at >= low[:, :, None]) & (at <= low[:, :, None] + 2 * half)
                if taken == 1 and share >= ONE_CURVE:
                    held = inside.mean(axis=(1, 2))
                    if held.max() >= AIM:
                        return 1, share, stretched, int(held.argmax())
                elif np.take_along_axis(inside, best[:taken, :, None], axis=0).any(axis=0).mean() >= AIM:
                    return taken, share, stretched, -1
    return 1, 1.0, False, 0


def _vectors(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(x, np.float64) for x in column]) if len(column) else np.empty((0, 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _true_neighbours(kept: DataFrame, few: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A bounded number of sampled rows and their ``k`` nearest of all rows, by a full scan."""
    asked = few.iloc[:: max(1, len(few) // FIT)].head(FIT)
    ids, v = asked.uid.to_numpy(), _vectors(asked.embedding)
    shared = kept.sparkSession.sparkContext.broadcast((ids, v))  # FIT vectors

    def best(batches):
        ids, v = shared.value
        top: list[list[tuple]] = [[] for _ in ids]
        for b in batches:
            m, own = _matrix(b.column("embedding")), np.asarray(b.column("uid"))
            score = v @ m.T
            score[own[None, :] == ids[:, None]] = -np.inf
            first = np.argsort(-score, axis=1, kind="stable")[:, :k]
            for i, row in enumerate(first):
                top[i] = sorted(top[i] + [(-score[i, j], own[j], m[j]) for j in row if score[i, j] > -np.inf], key=lambda x: x[:2])[:k]
        rows = [(i, -s, u, x.tolist()) for i, t in enumerate(top) for s, u, x in t]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())), strict=True)], names=["asked", "score", "uid", "embedding"])

    found = kept.select("uid", "embedding").mapInArrow(best, "asked int, score double, uid long, embedding array<double>")
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "uid")
    got = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).orderBy("asked", "n").toPandas()  # FIT * k vectors
    sizes = got.groupby("asked").size()
    n = int(sizes.min()) if len(sizes) == len(asked) else 0
    return v, _vectors(got[got.n <= n].embedding).reshape(len(asked), n, v.shape[1]) if n else np.empty((0, 0, v.shape[1]))


def nearest(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row that ``queries`` picks."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    held = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(held).alias("embedding"), F.coalesce(queries, F.lit(False)).alias("query")).filter("vec_id is not null and embedding is not null")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.filter(whole)
    length = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if length is None:
        return spark.createDataFrame([], schema)
    # rows get numbers of their own, so that repeated ids stay apart; written once, the numbers hold
    rows = written(rows.filter(F.size("embedding") == length.d).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    copy = Window.partitionBy("embedding").orderBy("vec_id", "uid")
    few_copies = rows.withColumn("_copy", F.row_number().over(copy)).filter(F.col("_copy") <= k + 1)
    members = F.sort_array(F.collect_list(F.struct("vec_id", "uid"))).alias("members")
    kept = few_copies.groupBy("embedding").agg(members).select(F.col("members")[0]["uid"].alias("uid"), F.col("members")[0]["vec_id"].alias("vec_id"), "embedding", "members")
    kept = written(kept, "kept")
    square = lambda a, x: a + x.cast("double") * x.cast("double")
    facts = kept.agg(F.max(F.aggregate("embedding", F.lit(0.0), square)).alias("longest"), F.count("*").alias("n")).first()
    longest, n = float(np.sqrt(facts.longest)), facts.n
    few = kept.orderBy(F.xxhash64("vec_id"), "vec_id", "uid").limit(SAMPLE).toPandas()
    plan = make_plan(_vectors(few.embedding), longest)
    asked, true = _true_neighbours(kept, few, k)
    taken, share, stretched, one = fit_windows(plan, asked, true, longest) if len(true) else (1, 1.0, False, 0)
    width = min(n, max(k + 1, int(np.ceil(share * n / taken))))
    if width * taken >= n:  # few rows: one window over one whole curve
        taken, width, one = 1, n, max(one, 0)
    shared = spark.sparkContext.broadcast(plan)  # CURVES projections and CURVES * SAMPLE keys

    def keyed(batches):
        for b in batches:
            v, asks = _matrix(b.column("embedding")), np.asarray(b.column("query"), bool)
            for is_query in (False, True):
                own = np.flatnonzero(asks == is_query)
                if not len(own):
                    continue
                keys, far = curve_keys(v[own], longest, shared.value, is_query and stretched)
                use = np.argsort(np.argsort(-far, axis=0, kind="stable"), axis=0) < (taken if is_query else CURVES)
                if one >= 0:
                    use[:], use[one] = False, True
                for c in range(CURVES):
                    at = np.flatnonzero(use[c])
                    if len(at):
                        rows = b.take(pa.array(own[at]))
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(at), c, np.int32)), pa.array(keys[c][at])], names=[*rows.schema.names, "curve", "key"])

    def ranked(batches):
        """Each row's block and the number of candidates before it there."""
        block, before = TaskContext.get().partitionId(), {}
        for b in batches:
            curve, row = np.asarray(b.column("curve")), ~np.asarray(b.column("query"), bool)
            place = np.empty(len(curve), np.int64)
            for c in np.unique(curve).tolist():
                at = np.flatnonzero(curve == c)
                place[at] = np.cumsum(row[at]) - row[at] + before.get(c, 0)
                before[c] = before.get(c, 0) + int(row[at].sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(curve), block, np.int32)), pa.array(place)], names=[*b.schema.names, "block", "place"])

    both = kept.drop("members").withColumn("query", F.lit(False)).unionByName(rows.filter("query").select("uid", "vec_id", "embedding", "query"))
    fields = f"uid long, vec_id long, embedding {held}, query boolean, curve int, key long"
    blocks = (1 if one >= 0 else CURVES) * max(BLOCKS, -(-n // BLOCK_ROWS))
    dealt = both.mapInArrow(keyed, fields).repartitionByRange(blocks, "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "query", "vec_id", "uid")
    placed = written(dealt.mapInArrow(ranked, f"{fields}, block int, place long"), "curves")

    # ranks: a block's first row comes after all rows of the curve's earlier blocks
    size = placed.filter("not query").groupBy("curve", "block").agg(F.count("*").alias("size"))
    order = Window.partitionBy("curve").orderBy("block")
    edges = written(placed.select("curve", "block").distinct().join(size, ["curve", "block"], "left").select("curve", "block", F.coalesce("size", F.lit(0)).alias("size")).withColumn("low", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")), "blocks")
    # cells of ranks, however the rows are dealt to partitions: a window meets those it covers
    cell_rows = min(BLOCK_ROWS, -(-n // CELLS))
    numbered = placed.join(edges.select("curve", "block", "low"), ["curve", "block"]).withColumn("at", F.col("low") + F.col("place"))
    cell = lambda x: F.floor(x / cell_rows).cast("long")
    start = F.greatest(F.lit(0), F.least(F.col("at") - width // 2, F.lit(n - width)))
    windows = numbered.filter("query").select("curve", "uid", "vec_id", "embedding", start.alias("first"), (start + width).alias("last"))
    met = windows.select("*", F.explode(F.sequence(cell(F.col("first")), cell(F.col("last") - 1))).alias("cell"))
    met = met.select("curve", "cell", "uid", "vec_id", "embedding", F.greatest(F.lit(0), F.col("first") - F.col("cell") * cell_rows).alias("a"), F.least(F.lit(cell_rows), F.col("last") - F.col("cell") * cell_rows).alias("b"))
    groups = F.ceil(F.col("asked") / QUERY_ROWS).cast("int")
    crowd = written(met.groupBy("curve", "cell").agg(F.count("*").alias("asked")).select("curve", "cell", groups.alias("groups")), "crowds")
    met = met.join(crowd, ["curve", "cell"]).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("groups")).cast("int")).drop("groups")
    held_rows = numbered.filter("not query").select("curve", cell(F.col("at")).alias("cell"), "uid", "vec_id", "embedding", (F.col("at") % cell_rows).alias("place")).join(crowd, ["curve", "cell"]).select("*", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part")).drop("groups")

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            c, q = c.sort_values("place", kind="stable"), q.sort_values(["a", "b"], kind="stable")
            own, ids, m = c.uid.to_numpy(), c.vec_id.to_numpy(), _vectors(c.embedding)
            asked, v, a, b = q.uid.to_numpy(), _vectors(q.embedding), q.a.to_numpy(), q.b.to_numpy()
            query_ids = q.vec_id.to_numpy()
            for i in range(0, len(q), 32):
                lo, hi = int(a[i : i + 32].min()), int(b[i : i + 32].max())
                score = v[i : i + 32] @ m[lo:hi].T
                at = np.arange(lo, hi)
                out_of = (at[None, :] < a[i : i + 32, None]) | (at[None, :] >= b[i : i + 32, None])
                score[out_of] = -np.inf
                top = np.array([np.lexsort((own[lo:hi], ids[lo:hi], -s))[: k + 1] for s in score])
                n_top = top.shape[1]
                out.append(pd.DataFrame({"uid": np.repeat(asked[i : i + 32], n_top), "query_id": np.repeat(query_ids[i : i + 32], n_top), "other": own[lo:hi][top].ravel(), "vec_id": ids[lo:hi][top].ravel(), "score": np.take_along_axis(score, top, axis=1).ravel()}))
        out = pd.concat(out) if out else pd.DataFrame({"uid": [], "query_id": [], "other": [], "vec_id": [], "score": []}).astype({"uid": "int64", "query_id": "int64", "other": "int64", "vec_id": "int64"})
        return out[out.score > -np.inf]

    met, held_rows = met.toDF(*met.columns), held_rows.toDF(*held_rows.columns)
    keys = ["curve", "cell", "part"]
    found = met.groupBy(*keys).cogroup(held_rows.groupBy(*keys)).applyInPandas(best, "uid long, query_id long, other long, vec_id long, score double")
    found = found.groupBy("uid", "query_id", "other", "vec_id").agg(F.max("score").alias("score"))
    # of k + 1 vectors each has a member besides the query: the k nearest rows are among theirs
    near = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id", "other")
    found = found.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k + 1)
    found = found.select("uid", "query_id", "other", "score").join(kept.select(F.col("uid").alias("other"), "members"), "other")
    found = found.select("uid", "query_id", "score", F.inline("members").alias("vec_id", "member")).filter("member <> uid")
    nearest_first = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id", "member")
    return found.withColumn("rank", F.row_number().over(nearest_first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
