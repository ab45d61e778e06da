"""Mixing sources to target weights by temperature, with DataFrame functions only.

Source weights are token shares to the power of an exponent, normalised. The exponent is bisected:
as it falls from 1 to 0 the weights' entropy rises and small sources repeat more often. The
result is the largest exponent that reaches the target entropy, unless a source would then repeat
more than the limit allows; then it is the smallest exponent that keeps the limit.

The weights become token budgets. Each source's documents are dealt by hash into blocks of about
``block_tokens`` tokens. A source is passed over as often as its budget says; each pass takes the
blocks in a permutation of its own, and the last pass stops inside the block where the budget
ends. No step brings a source together: blocks are small groups, sums are pre-aggregated.

Defined cases: a null source is a source of its own; null or empty texts have no tokens and ride
with their block; a text longer than a block makes a large block; documents of one hash are
ordered by doc_id, then tokens; sources without any token get no budget; repeated rows count as rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written

STEPS = 8
_POINTS = 16
#: Hexadecimal digits that pick a block's slice of its pass.
SLICE = 3


class Plan(NamedTuple):
    exponent: float
    entropy: float
    repeats: float


def _at(sources: DataFrame, exponents: list[float], total: int, budget: float) -> list[Plan]:
    """Entropy and most repetitions for each exponent, in one aggregation over the sources."""
    p = F.col("tokens") / F.lit(float(total))
    grid = sources.select(p.alias("p"), F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    rows = grid.groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("d"), F.max(F.pow("p", F.col("a") - 1)).alias("m")).orderBy("a").collect()
    return [Plan(r.a, math.log(r.z) - r.a * r.d / r.z, budget / total * r.m / r.z) for r in rows]


def exponent(sources: DataFrame, total: int, budget: float, target_entropy: float, max_repeats: float) -> Plan:
    """Bisection, four halvings a step: each step's points come from one aggregation."""

    def bisect(good) -> tuple[float, float]:
        lo, hi = 0.0, 1.0
        for _ in range(STEPS):
            points = [lo + (hi - lo) * k / _POINTS for k in range(_POINTS + 1)]
            ok = [good(x) for x in _at(sources, points, total, budget)]
            k = next((k for k in range(len(ok) - 1) if ok[k] != ok[k + 1]), None)
            if k is None:
                return (1.0, 1.0) if ok[0] else (0.0, 0.0)
            lo, hi = points[k], points[k + 1]
        return lo, hi

    # entropy falls with the exponent: the last point that reaches it; repeats fall too: the first that keeps the limit
    spread = bisect(lambda x: x.entropy >= target_entropy)[0]
    kept = bisect(lambda x: x.repeats > max_repeats)[1]
    ends = _at(sources, [0.0, 1.0], total, budget)
    if ends[1].entropy >= target_entropy:
        spread = 1.0
    if ends[0].repeats <= max_repeats:
        kept = 0.0
    return _at(sources, [max(spread, kept)], total, budget)[0]


def mixed(docs: DataFrame, budget_share: float = 1.0, entropy_share: float = 0.97, max_repeats: float = 4.0, block_tokens: int = 200_000, seed: str = "mix") -> DataFrame:
    """(doc_id, source, n_tokens, pass, block, block_pos, doc_pos, at): a row for every time a
    document is drawn. ``block_pos`` is the block's place in its pass, ``doc_pos`` the document's
    place in its block, ``at`` the share of the source's budget drawn before the block, by which
    sources interleave. The target entropy is ``entropy_share`` times that of equal weights."""
    tokens = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long").alias("n_tokens"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))), 1, 15), 16, 10).cast("long")
    tokens = written(tokens.withColumn("_s", F.coalesce(F.concat(F.lit("s:"), "source"), F.lit("null"))).withColumn("_h", hashed), "tokens")
    sources = written(tokens.groupBy("_s").agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0"), "sources")
    facts = sources.agg(F.sum("tokens").alias("total"), F.count("*").alias("n")).first()
    total = facts.total or 1
    budget = budget_share * total
    found = exponent(sources, total, budget, entropy_share * math.log(max(1, facts.n)), max_repeats) if facts.n else Plan(1.0, 0.0, 0.0)

    power = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(found.exponent))
    z = sources.agg(F.sum(power).alias("z")).first().z or 1.0
    budgets = sources.select("_s", "tokens", F.round(power / F.lit(z) * F.lit(budget)).cast("long").alias("budget"), F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long").alias("n_blocks"))

    placed = tokens.join(budgets, "_s").withColumn("block", F.pmod(F.col("_h"), F.col("n_blocks"))).drop("n_blocks")
    blocks = placed.groupBy("_s", "block").agg(F.sum("n_tokens").alias("block_tokens"), F.first("tokens").alias("tokens"), F.first("budget").alias("budget"))
    passes = blocks.filter("budget > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("budget") - 1) / F.col("tokens")))))
    # a pass's blocks in order of a hash, in slices by its first digits: sums within slices, and over
    # the slices, of which a pass has at most 16 ** SLICE
    keyed = passes.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), "_s", "pass", "block"))).withColumn("slice", F.substring("key", 1, SLICE))
    over = Window.partitionBy("_s", "pass").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = keyed.groupBy("_s", "pass", "slice").agg(F.sum("block_tokens").alias("t"), F.count("*").alias("n"))
    slices = slices.select("_s", "pass", "slice", F.coalesce(F.sum("t").over(over), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n0"))
    order = Window.partitionBy("_s", "pass", "slice").orderBy("key", "block")
    before = F.col("t0") + F.coalesce(F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("pass") * F.col("tokens")
    drawn = keyed.join(slices, ["_s", "pass", "slice"]).select("_s", "block", "pass", (F.col("n0") + F.row_number().over(order) - 1).cast("int").alias("block_pos"), (F.col("budget") - before).alias("left"), (before / F.col("budget")).alias("at")).filter("left > 0")

    inside = Window.partitionBy("_s", "block").orderBy("_h", "doc_id", "n_tokens")
    ranked = placed.select("doc_id", "source", "n_tokens", "_s", "block", (F.row_number().over(inside) - 1).alias("doc_pos"), (F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")).alias("before"))
    return ranked.join(drawn, ["_s", "block"]).filter("before < left").select("doc_id", "source", "n_tokens", "pass", "block", "block_pos", "doc_pos", "at")
