import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import blending, bootstrap, context, lookup, metrics, weights

RNG = np.random.default_rng(11)
N = 600
Y = (RNG.random(N) < 0.2).astype(int)
P = np.round(np.clip(RNG.normal(0.3 + 0.25 * Y, 0.2), 0, 1), 2)
A = np.round(RNG.random(N) * 300, 2)


def scored(spark, y=Y, p=P, a=A):
    return spark.createDataFrame([(i, int(b), float(c), float(d)) for i, (b, c, d) in enumerate(zip(y, p, a))],
                                 "id int, is_fraud int, score double, abs_amount double")


def ap(y, p):
    y, p = np.asarray(y), np.asarray(p)
    total, steps = y.sum(), 0.0
    for v in np.unique(p)[::-1]:
        hit = p >= v
        steps += y[p == v].sum() * y[hit].sum() / hit.sum()
    return steps / total


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return float(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))


def test_rank_quality(spark):
    r = metrics.rank_quality(scored(spark)).first()
    assert r["average_precision"] == pytest.approx(ap(Y, P))
    assert r["roc_auc"] == pytest.approx(auc(Y, P))


def test_monotone_rescoring_leaves_ranks_alone(spark):
    a = metrics.ap_value(scored(spark))
    assert metrics.ap_value(scored(spark, p=P ** 3)) == pytest.approx(a)


def test_pr_curve_ends_at_full_recall(spark):
    rows = sorted(metrics.pr_curve(scored(spark)).collect(), key=lambda r: r["threshold"])
    assert rows[0]["recall"] == 1.0 and rows[0]["precision"] == pytest.approx(Y.mean())
    assert len(rows) == len(np.unique(P))


def test_cost_of_missed_fraud(spark):
    df = scored(spark, [1, 1, 0, 0], [0.0] * 4, [100, 250, 10, 10])
    r = metrics.cost_at(df, 0.5).first()
    assert (r["fn"], r["fn_cost"], r["fp_cost"], r["precision"], r["block_rate"]) == (2, 350.0, 0.0, 0.0, 0.0)
    blocked = metrics.cost_at(df, 0.0).first()
    assert (blocked["fp"], blocked["fp_cost"], blocked["recall"]) == (2, 100.0, 1.0)
    average = metrics.cost_at(df, 0.5, fee=1.0, mode="average").first()
    assert average["fn_cost"] == pytest.approx(2 * (175 + 1))


def test_sweep_equals_single_thresholds(spark):
    df = scored(spark)
    rows = {r["threshold"]: r for r in metrics.cost_sweep(df).collect()}
    assert len(rows) == 99
    for t in (0.01, 0.29, 0.57, 0.99):  # 0.29 and 0.57 are the ones a multiplied index gets wrong
        one = metrics.cost_at(df, t).first()
        for c in ("tp", "fp", "fn"):
            assert rows[t][c] == one[c], (t, c)
        assert rows[t]["total_cost"] == pytest.approx(one["total_cost"])
    recalls = [rows[t]["recall"] for t in sorted(rows)]
    assert recalls == sorted(recalls, reverse=True)
    best = metrics.cheapest(metrics.cost_sweep(df)).first()
    assert best["total_cost"] == min(r["total_cost"] for r in rows.values())


def test_do_nothing(spark):
    assert metrics.do_nothing(scored(spark, [1, 0, 1], [0, 0, 0], [70, 999, 30])).first()[0] == 100.0


def ece(s, y, bins=20):
    edges = np.unique(np.quantile(s, np.linspace(0, 1, bins + 1)))
    at = np.clip(np.digitize(s, edges[1:-1]), 0, len(edges) - 2)
    return sum((at == b).sum() * abs(s[at == b].mean() - y[at == b].mean()) for b in set(at)) / len(s)


def test_calibration_error(spark):
    assert metrics.calibration_error(scored(spark)).first()[0] == pytest.approx(ece(P, Y))
    assert metrics.calibration_error(scored(spark, p=np.full(N, 0.5))).first()[0] is None


def test_review_threshold(spark):
    df = scored(spark)
    assert metrics.review_threshold(df, 10.0) == pytest.approx(round(float(np.quantile(P, 0.998)), 6))
    assert metrics.review_threshold(df, 0.2) == pytest.approx(0.198)


def test_isotonic_lowers_calibration_error(spark):
    true = RNG.random(4000) * 0.2
    y = (RNG.random(4000) < true).astype(int)
    raw = np.clip(true * 4, 0, 1)
    df = scored(spark, y, raw, raw)
    xs, ys = blending.fit_isotonic(df)
    assert ys == sorted(ys) and len(xs) <= 512 and 0 <= ys[0] and ys[-1] <= 1
    out = lookup.interpolate(df, xs, ys, "score", "cal")
    before, after = (metrics.calibration_error(out, c).first()[0] for c in ("score", "cal"))
    assert after < before / 2


def test_interpolation_equals_numpy_with_repeated_knots(spark):
    xs, ys = [0.0, 0.2, 0.2, 0.5, 1.0], [0.1, 0.2, 0.4, 0.4, 0.9]
    values = [-1.0, 0.0, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 2.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, v double")
    got = [r["y"] for r in lookup.interpolate(df, xs, ys, "v", "y").orderBy("i").collect()]
    assert got[:-1] == pytest.approx(list(np.interp(values, xs, ys))) and got[-1] is None


def test_simplex(spark):
    for k, n in ((1, 1), (2, 11), (3, 66)):
        points = [r["weights"] for r in blending.simplex(spark, k).collect()]
        assert len(points) == n and all(abs(sum(p) - 1) < 1e-9 for p in points)
    assert [0.0, 0.0, 1.0] in points and [1.0, 0.0, 0.0] in points


def test_blend(spark):
    df = spark.createDataFrame([(0.2, 0.4), (0.4, 0.8)], "a double, b double")
    cols = {"a": F.col("a"), "b": F.col("b")}
    assert [r[0] for r in df.select(blending.blend(cols, {})).collect()] == pytest.approx([0.3, 0.6])
    assert [r[0] for r in df.select(blending.blend({"a": F.col("a")}, {"a": 0.5, "b": 0.5})).collect()] == [0.2, 0.4]


def test_blend_is_never_worse_than_a_member(spark):
    df = scored(spark).withColumn("other", F.rand(5))
    best = blending.blend_grid(df, ["score", "other"]).agg(F.max("average_precision")).first()[0]
    assert best >= metrics.ap_value(df) - 1e-12
    assert set(blending.best_blend(df, ["score", "other"])) == {"score", "other"}


@pytest.mark.parametrize("slice_rows", [10**6, 10])
def test_bootstrap_brackets_the_point(spark, slice_rows):
    r = bootstrap.ap_interval(scored(spark), n_boot=200, slice_rows=slice_rows).first()
    assert r["ci_low"] < r["point"] < r["ci_high"] and r["n_boot"] == 200
    # Reference spread from plain resampling of rows.
    rng = np.random.default_rng(1)
    pos, neg = np.flatnonzero(Y == 1), np.flatnonzero(Y == 0)
    reps = []
    for _ in range(200):
        i = np.r_[rng.choice(pos, len(pos)), rng.choice(neg, len(neg))]
        reps.append(ap(Y[i], P[i]))
    assert r["std"] == pytest.approx(np.std(reps), rel=0.35)
    assert r["ci_low"] == pytest.approx(np.percentile(reps, 2.5), abs=0.04)


def test_paired_bootstrap_uses_the_same_draws(spark):
    # A model against a monotone copy of itself: every replicate must agree exactly, also when
    # the two scores are cut into slices and most rows tie on one of them.
    df = scored(spark, p=np.where(RNG.random(N) < 0.4, 0.5, P)).withColumn("copy", F.col("score") * 0.5)
    reps = bootstrap.replicates(df, ["score", "copy"], n_boot=40, slice_rows=12).collect()
    assert len(reps) == 40 and max(abs(r["ap_0"] - r["ap_1"]) for r in reps) < 1e-12
    worse = df.withColumn("noise", F.rand(3))
    r = bootstrap.paired_delta(worse, "noise", "score", n_boot=60, slice_rows=50).first()
    assert r["delta_point"] > 0 and r["significant_at_95"] and r["p_b_better_fraction"] == 1.0


def dated(spark):
    return spark.createDataFrame(
        [(0, 0), (1, 0), (2, 1), (3, 0)], "d int, is_fraud int").select(
        "is_fraud", F.expr("timestamp'2020-01-01' + make_dt_interval(d * 10)").alias("date"))


def test_weights(spark):
    assert sorted(r[0] for r in weights.class_weight(dated(spark)).select("class_weight").collect()) == [1, 1, 1, 3]
    w = [r[0] for r in weights.recency_weight(dated(spark), 10).orderBy("date").select("recency_weight").collect()]
    assert w == pytest.approx([0.125, 0.25, 0.5, 1.0])
    assert {r[0] for r in weights.recency_weight(dated(spark), 0).select("recency_weight").collect()} == {1.0}
    c = weights.combined_weight(dated(spark), 10)
    assert c.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)
    raw = np.array([0.125, 0.25, 1.5, 1.0])
    assert weights.effective_sample_size(c).first()[0] == pytest.approx(raw.sum() ** 2 / (raw ** 2).sum())
    even = dated(spark).withColumn("weight", F.lit(2.0))
    assert weights.effective_sample_size(even).first()[0] == 4.0


def test_bands_and_percentiles(spark):
    df = spark.createDataFrame([(0.0, 0), (0.0005, 1), (0.5, 1), (1.0, 1), (0.03, 0)], "score double, is_fraud int")
    bands = {r["band"]: r for r in context.score_bands(df).collect()}
    assert len(bands) == 8 and bands[0]["n"] == 2 and bands[7]["frauds"] == 2 and bands[1]["fraud_rate"] is None
    far = spark.createDataFrame([(5.0,), (-1.0,)], "s double")
    assert {r["b"] for r in lookup.band_of(far, context.BAND_EDGES, "s", "b").collect()} == {7}
    knots = [0.0] * 50 + [float(i) for i in range(51)]
    at = spark.createDataFrame([(0, -1.0), (1, 0.0), (2, 25.0), (3, 50.0)], "i int, v double")
    got = [r["p"] for r in lookup.percentile_of(at, knots, "v", "p").orderBy("i").collect()]
    assert got == pytest.approx([0.0, 0.0, 0.75, 1.0])


def test_context_sentences(spark):
    rows = [("Visa", 1 if i < 30 else 0, 10.0 + i) for i in range(300)] + [("Rare", 0, 5.0)] * 5
    df = spark.createDataFrame(rows, "card_brand string, is_fraud int, abs_amount double").withColumn("weight", F.lit(1.0))
    rates = context.category_rates(df, columns=["card_brand"])
    assert [r["level"] for r in rates.collect()] == ["Visa"]  # five rows are too few to quote
    ctx = context.load_context(context.percentile_knots(df, ["abs_amount"]), rates, None, 0.05, 275)
    ask = spark.createDataFrame([("Visa", 500.0), ("Rare", None), (None, 1.0)], "card_brand string, abs_amount double")
    brand, amount = context.evidence("card_brand", ctx), context.evidence("abs_amount", ctx)
    got = context.with_percentiles(ask, ctx).select(brand["evidence"], amount["evidence"], brand["lift"]).collect()
    assert got[0][0].startswith("card brand = Visa: fraud in 10.00% of ") and got[0][0].endswith(" in all rows, 2.0 times as much")
    assert got[0][1].endswith("= 500.00: above 100.0% of rows without fraud")
    assert got[1][0] == "card brand = Rare: too few rows to compare" and got[1][1].endswith("was not given")
    assert got[2][0] == "card brand was not given" and "below 100.0%" in got[2][1]
    assert math.isclose(ctx.knots["abs_amount"][0], 5.0)


def _sequential(points):
    """Isotonic values of (score, positives, rows) by the plain stack."""
    stack = []
    for x, p, n in sorted(points):
        stack.append([[x], p, n])
        while len(stack) > 1 and stack[-2][1] * stack[-1][2] >= stack[-1][1] * stack[-2][2]:
            xs, p, n = stack.pop()
            stack[-1] = [stack[-1][0] + xs, stack[-1][1] + p, stack[-1][2] + n]
    return [(xs[0], xs[-1], p, n) for xs, p, n in stack]


@pytest.mark.parametrize("shape", ["noise", "falling", "rising", "steps"])
@pytest.mark.parametrize("block_rows", [40, 500_000])
def test_isotonic_blocks_equal_the_sequential_ones(spark, shape, block_rows):
    import random

    rng = random.Random(block_rows)
    rate = {"noise": lambda x: 0.3, "falling": lambda x: 1 - x, "rising": lambda x: x, "steps": lambda x: int(x * 5) % 2}[shape]
    rows = [(x / 500, int(rng.random() < rate(x / 500))) for x in (rng.randrange(500) for _ in range(3000))]
    df = spark.createDataFrame([*rows, (None, 1), (float("nan"), 1), (0.5, None)], "score double, is_fraud int").repartition(10)
    points = {}
    for x, y in rows:
        p, n = points.get(x, (0, 0))
        points[x] = p + y, n + 1
    want = _sequential([(x, p, n) for x, (p, n) in points.items()])
    blocks = blending.isotonic_blocks(df, block_rows=block_rows)
    assert sorted((r["lo"], r["hi"], r["pos"], r["n"]) for r in blocks.collect()) == want
    at = sorted({rng.random() * 1.2 - 0.1 for _ in range(60)} | {x for x, _ in rows[:40]})
    xs = [x for lo, hi, _, _ in want for x in ((lo, hi) if lo < hi else (lo,))]
    ys = [p / n for lo, hi, p, n in want for _ in ((lo, hi) if lo < hi else (lo,))]
    assert blending.curve_at(blocks, at) == pytest.approx(list(np.interp(at, xs, ys)))


def test_isotonic_of_no_rows_has_no_knots(spark):
    none = spark.createDataFrame([], "score double, is_fraud int")
    assert blending.fit_isotonic(none) == ([], [])
    one = spark.createDataFrame([(0.5, 1)] * 3, "score double, is_fraud int")
    assert blending.fit_isotonic(one) == ([0.5], [1.0])


def test_splitting_tree_gives_every_task_the_same_draws():
    """Slices of both axes, walked on their own, agree on every cell, and cells and what lies ahead add up to all draws."""
    rng = np.random.default_rng(2)
    tree = bootstrap.Splits(3, 2)
    cells = {(i, j): (int(rng.integers(0, 4)), int(rng.integers(0, 30))) for i in range(8) for j in range(8) if rng.random() < 0.7}
    cells = {k: v for k, v in cells.items() if any(v)}
    totals = {}
    for (i, j), (p, n) in cells.items():
        for level in range(1, tree.depth + 1):
            ib, jb = tree.taken(level)
            node = level, i >> 3 - ib, j >> 3 - jb
            a, b = totals.get(node, (0, 0))
            totals[node] = a + p, b + n
    everything = tuple(int(sum(v[c] for v in cells.values())) for c in (0, 1))
    seen = {}
    for axis in (0, 1):
        reached = {}
        for slab in range(8):
            got, ahead = tree.walk(axis, slab, totals, everything, 4000, 5)
            reached[slab] = sum(got.values(), np.zeros((4000, 2), np.int64)), ahead
            for cell, draws in got.items():
                assert cell[axis] == slab and (draws == seen.setdefault(cell, draws)).all()
        for slab in range(8):
            later = sum((reached[s][0] for s in range(slab + 1, 8)), np.zeros((4000, 2), np.int64))
            assert (reached[slab][1] == later).all()
        assert (sum(r[0] for r in reached.values()) == everything).all()
    for cell, (p, n) in cells.items():  # a multinomial: means and variances of its cells
        for c, t in ((0, p), (1, n)):
            share = t / everything[c]
            assert seen[cell][:, c].mean() == pytest.approx(t, abs=5 * np.sqrt(max(t, 0.01) / 4000))
            assert seen[cell][:, c].var() == pytest.approx(everything[c] * share * (1 - share), rel=0.2, abs=0.05)


def test_slices_of_any_size_give_the_same_distribution(spark):
    df = scored(spark)
    one = bootstrap.replicates(df, ["score"], n_boot=600, slice_rows=10**9).toPandas()["ap_0"]
    many = bootstrap.replicates(df, ["score"], n_boot=600, slice_rows=7).toPandas()["ap_0"]
    assert many.mean() == pytest.approx(one.mean(), abs=4 * one.std() / np.sqrt(600) * 1.5) and many.std() == pytest.approx(one.std(), rel=0.2)


def test_bootstrap_of_no_rows(spark):
    none = spark.createDataFrame([], "score double, is_fraud int")
    assert bootstrap.replicates(none, ["score"], n_boot=5).count() == 0


def test_bootstrap_slices_are_not_joined_to_one_task(spark):
    df = scored(spark).localCheckpoint()
    plan = bootstrap.replicates(df, ["score"], n_boot=3, slice_rows=20)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan
