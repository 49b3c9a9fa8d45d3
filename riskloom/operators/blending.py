"""Blending model scores and calibrating the blend."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.lookup import locate
from riskloom.operators.metrics import rank_quality
from riskloom.operators.ordering import quantile_list
from riskloom.schema import LABEL
from riskloom.sources.shared import materialize, release, scope

MAX_KNOTS = 512
STEPS = 10
# Blocks of an isotonic regression that one task pools.
BLOCK_ROWS = 500_000


def simplex(spark, k: int, steps: int = STEPS) -> DataFrame:
    """Every weight vector of k parts in units of 1/steps, as (point, weights).

    Built as a generated range: each point is the base-(steps+1) digits of a number, kept where
    the digits add up to ``steps``. Points come out in lexicographic order.
    """
    base = steps + 1
    digits = [F.floor(F.col("id") / F.lit(base ** (k - 1 - i))).cast("bigint") % base for i in range(k)]
    total = sum(digits[1:], digits[0])
    kept = spark.range(base ** k, numPartitions=1).where(total == steps)
    return kept.select(F.col("id").alias("point"), F.array(*[d.cast("double") / steps for d in digits]).alias("weights"))


def blend(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean renormalised over the members at hand; without any weight, the plain mean."""
    total = sum(weights.get(n, 0.0) for n in scores)
    if total <= 0:
        cols = list(scores.values())
        return sum(cols[1:], cols[0]) / len(cols)
    terms = [F.lit(float(weights.get(n, 0.0))) * c for n, c in scores.items()]
    return sum(terms[1:], terms[0]) / F.lit(float(total))


def blend_grid(df: DataFrame, members: Sequence[str], label: str = LABEL, steps: int = STEPS) -> DataFrame:
    """(point, weights, average_precision) for every blend on the grid.

    Rows are first merged to distinct score tuples; the grid (fixed by k and steps, 66 points for
    three members) is generated inside each row, and all points are ranked in one pass.
    """
    tuples = df.groupBy(*members).agg(
        F.sum(label).cast("bigint").alias("pos"), F.sum(1 - F.col(label)).cast("bigint").alias("neg"))
    grid = [(r["point"], r["weights"]) for r in simplex(df.sparkSession, len(members), steps).collect()]
    options = F.array(*[
        F.struct(F.lit(p).alias("point"),
                 sum([F.lit(w) * F.col(m) for w, m in zip(ws, members)][1:], F.lit(ws[0]) * F.col(members[0])).alias("score"))
        for p, ws in grid])
    scored = tuples.select("pos", "neg", F.inline(options))
    from riskloom.operators.ordering import running_totals

    merged = scored.groupBy("point", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ranked = running_totals(merged, "score", ["pos", "neg"], ["point"], descending=True)
    step = F.col("pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    quality = ranked.groupBy("point").agg(
        (F.sum(step) / F.greatest(F.sum("pos"), F.lit(1))).alias("average_precision"))
    weights = F.element_at(F.create_map(*[x for p, ws in grid for x in (F.lit(p), F.array(*[F.lit(w) for w in ws]))]),
                           F.col("point"))
    return quality.select("point", weights.alias("weights"), "average_precision")


def best_blend(df: DataFrame, members: Sequence[str], label: str = LABEL, steps: int = STEPS) -> dict[str, float]:
    """The grid point with the highest average precision; the first one wins a tie."""
    best = blend_grid(df, members, label, steps).orderBy(F.desc("average_precision"), "point").first()
    return {m: round(w, 3) for m, w in zip(members, best["weights"])}


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pool adjacent violators of one task's blocks, which come in order; counts are compared exactly."""
    part, stack = TaskContext.get().partitionId(), []  # (lo, hi, positives, rows)
    for batch in batches:
        for lo, hi, pos, n in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "pos", "n"))):
            while stack and stack[-1][2] * n >= pos * stack[-1][3]:
                lo, _, p, m = stack.pop()
                pos, n = pos + p, n + m
            stack.append((lo, hi, pos, n))
    if stack:
        lo, hi, pos, n = zip(*stack)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(lo), pa.int32()), pa.array(lo, pa.float64()), pa.array(hi, pa.float64()), pa.array(pos, pa.int64()), pa.array(n, pa.int64())],
            names=["part", "lo", "hi", "pos", "n"])


def isotonic_blocks(df: DataFrame, score: str = "score", label: str = LABEL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(lo, hi, pos, n): the blocks of equal value of the isotonic regression of a 0/1 label, by pooling adjacent violators.

    Rows are merged to distinct scores first. Tasks pool the violators inside ranges of about ``block_rows`` blocks; the
    next round cuts other ranges, so that what met a border lies inside one; rounds end when no two neighbours
    across a border violate the order. The result does not depend on the cuts. No task and no driver holds more than
    one range, and the driver sees two blocks of each. Rows without a score (null, NaN) or label are left out.
    """
    known = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    points = known.groupBy((F.col(score).cast("double") + F.lit(0.0)).alias("lo")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    blocks = materialize(points.select("lo", F.col("lo").alias("hi"), "pos", "n"))
    parts = 0
    while True:
        wanted = max(1, -(-blocks.count() // block_rows))
        parts = wanted + 1 if wanted == parts > 1 else wanted  # other borders than those of the round before
        before, blocks = blocks, materialize(
            blocks.repartitionByRange(parts, "lo").sortWithinPartitions("lo").mapInArrow(_pooled, "part int, lo double, hi double, pos bigint, n bigint"))
        release(df.sparkSession, [before.table_path])
        block = F.struct("lo", "pos", "n")
        ends = sorted(blocks.groupBy("part").agg(F.min(block).alias("first"), F.max(block).alias("last")).collect(), key=lambda r: r["first"]["lo"])
        if all(a["last"]["pos"] * b["first"]["n"] < b["first"]["pos"] * a["last"]["n"] for a, b in zip(ends, ends[1:])):
            return blocks


def curve_at(blocks: DataFrame, knots: Sequence[float]) -> list[float]:
    """Values of an isotonic regression at sorted knots: flat in a block, linear between blocks, clamped at both ends.

    Blocks are placed between knots by binary search in the row pipeline; the driver gets the first and the last
    block of each place, two for each knot.
    """
    placed = locate(blocks, knots, "lo", "_place")
    block = F.struct("lo", "hi", (F.col("pos") / F.col("n")).alias("value"))
    ends = {r["_place"]: (r["first"], r["last"]) for r in placed.groupBy("_place").agg(F.min(block).alias("first"), F.max(block).alias("last")).collect()}
    after = [None] * (len(knots) + 1)  # the first block that starts beyond the knot before the place
    for place in range(len(knots), -1, -1):
        after[place] = ends[place][0] if place in ends else after[place + 1] if place < len(knots) else None
    out, last = [], ends[0][1] if 0 in ends else None
    for place, x in enumerate(knots, 1):
        # Place k holds blocks from knot k - 1 on, so a block that starts on this knot is the first of its place.
        here, following = ends.get(place), after[place]
        if here and here[0]["lo"] == x:
            out.append(here[0]["value"])
        elif last is None:
            out.append(following["value"])
        elif x <= last["hi"] or following is None:
            out.append(last["value"])
        else:
            share = (x - last["hi"]) / (following["lo"] - last["hi"])
            out.append(last["value"] + share * (following["value"] - last["value"]))
        last = here[1] if here else last
    return out


def fit_isotonic(df: DataFrame, score: str = "score", label: str = LABEL,
                 max_knots: int = MAX_KNOTS) -> tuple[list[float], list[float]]:
    """Monotone calibration curve thinned to at most ``max_knots`` knots.

    The knots are exact score quantiles; between them the curve is linear. Without rows there are none.
    """
    with scope(df.sparkSession):
        knots = sorted(set(quantile_list(df, score, [i / (max_knots - 1) for i in range(max_knots)])))
        return knots, curve_at(isotonic_blocks(df, score, label), knots) if knots else []


def val_quality(df: DataFrame, members: Sequence[str], label: str = LABEL) -> DataFrame:
    """Rank quality of several score columns at once: (model, average_precision, roc_auc, ...)."""
    long = df.select(label, F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in members])))
    return rank_quality(long, "score", label, ["model"])
