"""Work on many rows: factors evaluated once, percentiles in few steps, trees and Shapley values against plain versions, rows over all cores."""

from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import context, decisions, lookup
from riskloom.plans import attribution, boosting
from riskloom.schema import BINARY, FEATURES, NUMERIC
from riskloom.sources import shared
from riskloom.workload import learning


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def grown(rng, depth, features, width=66):
    tree = boosting.Tree()
    open_ = [(tree.add(rng.normal(), 100.0, width), 0)]
    while open_:
        k, d = open_.pop()
        if d >= depth or (d and rng.random() < 0.1):
            continue
        tree.feature[k], tree.goes_left[k] = int(rng.integers(features)), rng.random(width) < 0.5
        cover = tree.cover[k] * rng.random()
        tree.left[k], tree.right[k] = tree.add(rng.normal(), cover, width), tree.add(rng.normal(), tree.cover[k] - cover, width)
        open_ += [(tree.left[k], d + 1), (tree.right[k], d + 1)]
    return tree


@pytest.mark.parametrize("depth", [0, 1, 5, 6, 8])
def test_masks_find_the_leaf_that_steps_find(depth):
    rng = np.random.default_rng(depth)
    x = rng.integers(0, 66, (500, 9)).astype(np.uint8)
    tree = grown(rng, depth, 9).arrays()
    assert (boosting.land(tree, boosting.masks(tree), np.ascontiguousarray(x.T)) == boosting.stand(tree, x)).all()


def test_shapley_by_patterns_equals_row_by_row():
    rng = np.random.default_rng(3)
    model = boosting.Boosted(boosting.Binning([], []), 0.0, [grown(rng, 4, 5) for _ in range(6)])
    x = rng.integers(0, 66, (40, 5)).astype(float)
    numbers = [(0.7, [(0, 20.0, None, True, 0.4), (1, None, [3, 4, 40], False, 0.5), (0, 50.5, None, False, 0.2)])]
    x[0, 0], x[1, 1] = np.nan, 2000
    leaves = [*model.leaves(), *numbers]
    want = np.zeros((len(x), 5))
    for value, steps in leaves:
        for i, row in enumerate(x):
            follows, share = {}, {}
            for slot, threshold, cats, left, cover in steps:
                ok = bool(row[slot] <= threshold if cats is None else row[slot] in cats) == left
                follows[slot], share[slot] = follows.get(slot, True) and ok, share.get(slot, 1.0) * cover
            players = list(follows)
            for p in players:
                rest = [q for q in players if q != p]
                for chosen in range(1 << len(rest)):
                    inside = [q for j, q in enumerate(rest) if chosen >> j & 1]
                    weight = factorial(len(inside)) * factorial(len(rest) - len(inside)) / factorial(len(players))
                    others = np.prod([follows[q] if q in inside else share[q] for q in rest])
                    want[i, p] += value * weight * others * (follows[p] - share[p])
    assert attribution.shapley(x, leaves, list(range(5)), 5) == pytest.approx(want, abs=1e-9)


def test_percentiles_of_all_numbers_take_few_steps(spark):
    described = [c for c in NUMERIC if c not in BINARY]
    ctx = context.Context(knots={c: [float(k // 3) for k in range(101)] for c in described})
    df = spark.range(5).select("id", *[(F.col("id") * 9.5 - 2).alias(c) for c in FEATURES])
    out = context.with_percentiles(df, ctx)
    assert plan_of(out).count("Project") < 8  # however many numbers there are
    one = lookup.interpolate(df, ctx.knots[described[0]], [k / 100 for k in range(101)], described[0], "p").collect()
    assert [r[f"_pct_{described[0]}"] for r in out.collect()] == [0.0 if r.id == 0 else 1.0 if r.id == 4 else r.p for r in one]


def test_factors_are_not_evaluated_again_for_a_filter(spark):
    df = spark.range(3).select("id", *[F.lit("1" if c not in NUMERIC else 1.0).alias(c) for c in FEATURES], *[F.lit(float(i)).alias(f"_contrib_{c}") for i, c in enumerate(FEATURES)])
    ranked = decisions.top_factors(df, context.Context())
    assert ranked.select("id", F.inline_outer("top_factors")).count() == 3 * decisions.TOP_FACTORS
    assert "inline_outer" in learning.Q["top_factors"][0].__code__.co_names


def test_rows_in_few_files_are_dealt_over_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    few = spark.range(0, cores * 10_000, 1, 1)
    assert shared.spread(few, cores * 10_000).rdd.getNumPartitions() == cores
    assert shared.spread(few, 9_999).rdd.getNumPartitions() == 1
