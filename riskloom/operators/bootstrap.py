"""Stratified bootstrap of average precision, for one score or for two scores on the same draws.

Resampling rows with replacement inside each class is a multinomial over distinct scores. A multinomial splits
exactly into binomials along a tree over slices of the scores. A task draws along the paths to its own slice
only, seeded by node, so replicates never travel over the network, no task draws the whole grid, the driver sees
no table of cells, and no task holds more than one slice of the distinct scores.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.lookup import locate
from riskloom.operators.metrics import rank_quality
from riskloom.schema import LABEL
from riskloom.sources.shared import materialize

SLICE_ROWS = 20_000  # distinct scores aimed at per task
CHUNK = 2_000_000  # draws that a task holds at a time


def _edges(df: DataFrame, score: str, slices: int) -> tuple[list[float], set[int]]:
    """Slice edges along one score, and which slices hold a single (heavily repeated) value."""
    if slices <= 1:
        return [], set()
    probs = [i / slices for i in range(1, slices)]
    cuts = df.agg(F.percentile_approx(F.col(score).cast("double"), probs, max(10_000, 50 * slices))).first()[0]
    edges: set[float] = set()
    heavy: set[float] = set()
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            heavy.add(a)
            edges.add(math.nextafter(a, math.inf))
    edges |= set(cuts)
    ordered = sorted(edges)
    return ordered, {ordered.index(v) + 1 for v in heavy}


Totals = dict[tuple[int, int, int], tuple[int, int]]  # (level, i prefix, j prefix) -> positives, negatives


class Splits:
    """A binary tree over the grid of slices: levels halve the range of i and of j in turn (of i only, for one score).

    A node at level L is the pair of the first bits of i and j. Its draws are split between its halves by
    binomials seeded with the node, so tasks that share nodes get the same draws without exchanging any.
    """

    def __init__(self, bits: int, scores: int):
        self.bits, self.scores, self.depth = bits, scores, bits * scores

    def taken(self, level: int) -> tuple[int, int]:
        """How many bits of i and of j a level has."""
        return (level, 0) if self.scores == 1 else (-(-level // 2), level // 2)

    def halves(self, level: int, a: int, b: int) -> tuple[tuple[int, int, int], tuple[int, int, int]]:
        if self.taken(level + 1)[0] > self.taken(level)[0]:
            return (level + 1, 2 * a, b), (level + 1, 2 * a + 1, b)
        return (level + 1, a, 2 * b), (level + 1, a, 2 * b + 1)

    def span(self, axis: int, node: tuple[int, int, int]) -> tuple[int, int]:
        """First and last slice of a node along one axis."""
        spare = self.bits - self.taken(node[0])[axis]
        return node[1 + axis] << spare, (node[1 + axis] + 1 << spare) - 1

    def walk(self, axis: int, slab: int, totals: Totals, everything: tuple[int, int], n_boot: int, seed: int):
        """({cell: draws}, draws ahead) of one slice: arrays (replicates, 2 classes). Only nodes that the slice meets are split."""
        cells, ahead = {}, np.zeros((n_boot, 2), np.int64)
        open_nodes = [((0, 0, 0), everything, np.tile(np.array(everything, np.int64), (n_boot, 1)))]
        while open_nodes:
            node, whole, draws = open_nodes.pop()
            if node[0] == self.depth:
                cells[node[1], node[2]] = draws
                continue
            low, high = self.halves(*node)
            share = totals.get(low, (0, 0))
            first = np.stack([np.random.default_rng([seed, *node, c]).binomial(draws[:, c], share[c] / whole[c]) if whole[c] else draws[:, c] * 0 for c in (0, 1)], 1)
            for half, part in ((low, first), (high, draws - first)):
                lo, hi = self.span(axis, half)
                if lo > slab:
                    ahead += part
                elif hi >= slab and half in totals:
                    open_nodes.append((half, totals[half], part))
        return cells, ahead

    def totals(self, cells: DataFrame) -> DataFrame:
        """(level, a, b, p, n) of all nodes below the root that hold rows, from the cells (i, j, p, n)."""
        taken = [self.taken(level) for level in range(1, self.depth + 1)]
        nodes = F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright("i", self.bits - ib).alias("a"), F.shiftright("j", self.bits - jb).alias("b"))
                          for level, (ib, jb) in enumerate(taken, 1)])
        return cells.select(F.inline(nodes), "p", "n").groupBy("level", "a", "b").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))

    def for_slices(self, nodes: DataFrame, axis: int) -> DataFrame:
        """Each node once for every slice that its parent meets: those whose task splits the parent."""
        prefix = F.col("ab"[axis])
        spare, own = F.lit(None).cast("int"), F.lit(None).cast("int")
        for level in range(self.depth, 0, -1):
            here, up = self.taken(level)[axis], self.taken(level - 1)[axis]
            spare = F.when(F.col("level") == level, self.bits - up).otherwise(spare)
            own = F.when(F.col("level") == level, here - up).otherwise(own)
        above = F.call_function("shiftright", prefix, own)
        first = F.call_function("shiftleft", above, spare)
        last = F.call_function("shiftleft", above + 1, spare) - 1
        return nodes.select(F.explode(F.sequence(first, last)).alias("slab"), "level", "a", "b", "p", "n")


def _slab_steps(slab: int, rows: pd.DataFrame, nodes: pd.DataFrame, axis: int, tree: Splits, everything: tuple[int, int], n_boot: int, seed: int) -> pd.DataFrame:
    """Average-precision steps of one slice for every replicate."""
    totals = {(int(r.level), int(r.a), int(r.b)): (int(r.p), int(r.n)) for r in nodes.itertuples()}
    drawn, ahead = tree.walk(axis, slab, totals, everything, n_boot, seed)
    rows = rows.sort_values(["i", "j", "s0", "s1"], kind="stable").reset_index(drop=True)
    counts = rows[["pos", "neg"]].to_numpy(np.int64)
    value = rows["s0" if axis == 0 else "s1"].to_numpy()
    order = np.argsort(-value, kind="stable")
    ranked = value[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    # Each cell is a run of rows; it draws its rows from generators of its own, replicate after replicate.
    cell = rows["i"].to_numpy(np.int64) << 32 | rows["j"].to_numpy(np.int64)
    cuts = [*np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]).tolist(), len(rows)]
    runs = []
    for lo, hi in zip(cuts, cuts[1:]):
        at = int(cell[lo] >> 32), int(cell[lo] & 0xFFFFFFFF)
        of = counts[lo:hi].sum(0)
        runs.append((lo, hi, drawn[at], [(np.random.default_rng([seed, tree.depth, *at, 2 + c]), counts[lo:hi, c] / of[c]) if of[c] else None for c in (0, 1)]))
    steps = np.zeros(n_boot)
    several = max(1, CHUNK // max(len(rows), 1))
    for first in range(0, n_boot, several):
        last = min(first + several, n_boot)
        draws = np.zeros((2, last - first, len(rows)), np.int64)
        for lo, hi, total, generators in runs:
            for c, g in enumerate(generators):
                if g is not None:
                    draws[c, :, lo:hi] = g[0].multinomial(total[first:last, c], g[1])
        tp, fp = (np.add.reduceat(d[:, order], starts, axis=1) for d in draws)
        ctp, cfp = np.cumsum(tp, 1) + ahead[first:last, :1], np.cumsum(fp, 1) + ahead[first:last, 1:]
        steps[first:last] = (tp * (ctp / np.maximum(ctp + cfp, 1))).sum(1)
    return pd.DataFrame({"b": np.arange(n_boot), "steps": steps})


def _task(axis: int, tree: Splits, everything: tuple[int, int], n_boot: int, seed: int):
    def run(key, rows, nodes):
        if rows.empty:  # a slice without scores
            return pd.DataFrame({"b": pd.Series([], dtype="int64"), "steps": pd.Series([], dtype="float64")})
        return _slab_steps(int(key[0]), rows, nodes, axis, tree, everything, n_boot, seed)
    return run


def replicates(df: DataFrame, scores: list[str], label: str = LABEL, n_boot: int = 2000, seed: int = 0,
               slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(b, ap_0[, ap_1]): average precision of each score on each resample."""
    names = ["s0", "s1"][: len(scores)]
    groups = materialize(  # read by the count, the edges, the cells and every axis
        df.groupBy(*[F.col(s).cast("double").alias(n) for s, n in zip(scores, names)])
        .agg(F.sum(label).cast("bigint").alias("pos"), F.sum(1 - F.col(label)).cast("bigint").alias("neg"))
    )
    n, positives, negatives = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum("neg"), F.lit(0))).first()
    slices = max(1, math.ceil(n / slice_rows))
    hot: list[set[int]] = []
    placed, bits = groups, 0
    for name, into in zip(names, ("i", "j")):
        edges, single = _edges(groups, name, slices)
        placed = locate(placed, edges, name, into)
        bits = max(bits, len(edges).bit_length())
        hot.append(single)
    if len(scores) == 1:
        placed = placed.withColumns({"j": F.lit(0), "s1": F.lit(0.0)})
    tree = Splits(bits, len(scores))
    nodes = None
    if tree.depth:
        nodes = materialize(tree.totals(placed.groupBy("i", "j").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))))
    else:
        nodes = df.sparkSession.createDataFrame([], "level int, a int, b int, p bigint, n bigint")

    parts = []
    # Slices are few bytes and much work, so adaptive execution would join them to a task or two: the number is given.
    tasks = max(1, min(2 * slices, 4 * df.sparkSession.sparkContext.defaultParallelism))
    for axis, single in enumerate(hot):
        key, value, other = (("i", "s0", "s1"), ("j", "s1", "s0"))[axis]
        rows = placed.select("i", "j", "s0", "s1", "pos", "neg")
        if single:
            # A slice of one single value needs only its cell totals: the draws inside it all tie.
            is_hot = F.col(key).isin(sorted(single))
            merged = rows.where(is_hot).groupBy("i", "j", value).agg(
                F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).withColumn(other, F.lit(0.0))
            rows = rows.where(~is_hot).unionByName(merged)
        needed = tree.for_slices(nodes, axis) if tree.depth else nodes.withColumn("slab", F.lit(0))
        steps = rows.repartition(tasks, key).groupBy(key).cogroup(needed.groupBy("slab")).applyInPandas(
            _task(axis, tree, (int(positives), int(negatives)), n_boot, seed), "b bigint, steps double")
        parts.append(steps.groupBy("b").agg((F.sum("steps") / F.lit(max(float(positives), 1.0))).alias(f"ap_{axis}")))
    return parts[0] if len(parts) == 1 else parts[0].join(parts[1], "b")


def _interval(col: str) -> list:
    # The replicate table has n_boot rows, so the built-in exact percentile is safe here.
    return [F.percentile(col, F.lit(0.025)).alias("ci_low"), F.percentile(col, F.lit(0.975)).alias("ci_high")]


def ap_interval(df: DataFrame, score: str = "score", label: str = LABEL, n_boot: int = 2000,
                seed: int = 0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Point estimate, 95 % interval and spread of average precision."""
    reps = replicates(df, [score], label, n_boot, seed, slice_rows)
    point = rank_quality(df, score, label).select("average_precision").scalar()
    return reps.agg(*_interval("ap_0"), F.stddev_pop("ap_0").alias("std"),
                    F.count(F.lit(1)).cast("int").alias("n_boot")).withColumn("point", point)


def paired_delta(df: DataFrame, score_a: str, score_b: str, label: str = LABEL, n_boot: int = 2000,
                 seed: int = 0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Is score B better than score A? Both are ranked on the same resampled rows."""
    reps = replicates(df, [score_a, score_b], label, n_boot, seed, slice_rows).withColumn(
        "delta", F.col("ap_1") - F.col("ap_0"))
    ap = lambda s: rank_quality(df, s, label).select("average_precision").scalar()
    out = reps.agg(*_interval("delta"), F.avg((F.col("delta") > 0).cast("double")).alias("p_b_better_fraction"),
                   F.count(F.lit(1)).cast("int").alias("n_boot"))
    return out.withColumns({
        "delta_point": ap(score_b) - ap(score_a),
        "significant_at_95": (F.col("ci_low") > 0) | (F.col("ci_high") < 0),
    })
