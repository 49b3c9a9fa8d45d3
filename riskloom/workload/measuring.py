"""Queries: confusion, ranking, cost, calibration error, bootstrap, weights, blending."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import blending, bootstrap, metrics, splits, weights
from riskloom.operators.decisions import OperatingPoint, calibrate
from riskloom.operators.velocity import add_velocity
from riskloom.plans import reference, train
from riskloom.sources import sinks
from riskloom.sources.shared import materialize, scratch
from riskloom.workload.preparing import _VAL
from riskloom.workload.tables import TXN, read, split_sql, transactions

Q: dict = {}


def query(sql: str | None = None):
    def keep(fn):
        Q[fn.__name__] = (fn, sql)
        return fn
    return keep


def rounded(df, places: int = 9, skip: tuple[str, ...] = ()):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, places).alias(c) if kinds[c] == "double" and c not in skip else F.col(c)
                       for c in df.columns])


CONFUSION = """CAST(count(*) FILTER (p < {t} AND y = 0) AS BIGINT) AS tn, CAST(count(*) FILTER (p >= {t} AND y = 0) AS BIGINT) AS fp,
  CAST(count(*) FILTER (p < {t} AND y = 1) AS BIGINT) AS fn, CAST(count(*) FILTER (p >= {t} AND y = 1) AS BIGINT) AS tp"""


def _yp(score: str = "score", src: str = "t", where: str = "TRUE") -> str:
    return f"d AS (SELECT is_fraud AS y, {score} AS p, abs_amount AS a, CAST(abs_amount AS DECIMAL(18,6)) AS am FROM {src} WHERE {where})"


@query(f"WITH {TXN}, {_yp()} SELECT {CONFUSION.format(t='CAST(0.5 AS DOUBLE)')} FROM d")
def confusion(spark, sf):
    return metrics.confusion(transactions(spark, sf), 0.5)


@query(f"""WITH {TXN}, {_yp()}, c AS (SELECT {CONFUSION.format(t='CAST(0.4 AS DOUBLE)')} FROM d),
  q AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
    coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall FROM c)
  SELECT tn, fp, fn, tp, round(precision, 9) AS precision, round(recall, 9) AS recall,
    round(coalesce(2.0 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM q""")
def precision_recall_f1(spark, sf):
    return rounded(metrics.prf(metrics.confusion(transactions(spark, sf), 0.4)))


def _rank(score: str, src: str = "t", where: str = "TRUE") -> str:
    return f"""{_yp(score, src, where)},
  g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM d GROUP BY p),
  w AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(neg) OVER (ORDER BY p DESC) AS cn FROM g)"""


_AP = "sum(CAST(pos AS DOUBLE) * (CAST(cp AS DOUBLE) / (cp + cn))) / sum(pos)"
_AUC = "sum(CAST(neg AS DOUBLE) * (cp - pos) + CAST(neg AS DOUBLE) * pos / 2) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE))"


@query(f"WITH {TXN}, {_rank('round(score, 2)')} SELECT round({_AP}, 9) AS average_precision FROM w")
def average_precision(spark, sf):
    t = transactions(spark, sf).withColumn("score", F.round("score", 2))
    return rounded(metrics.average_precision(t))


@query(f"WITH {TXN}, {_rank('score')} SELECT round({_AP}, 9) AS average_precision FROM w")
def average_precision_fine(spark, sf):
    """The same measure on a score with few ties."""
    return rounded(metrics.average_precision(transactions(spark, sf)))


@query(f"WITH {TXN}, {_rank('score')} SELECT round({_AUC}, 9) AS roc_auc FROM w")
def roc_auc(spark, sf):
    return rounded(metrics.rank_quality(transactions(spark, sf)).select("roc_auc"))


@query(f"""WITH {TXN}, {_rank('score')} SELECT p AS threshold, round(CAST(cp AS DOUBLE) / (cp + cn), 9) AS precision,
  round(CAST(cp AS DOUBLE) / (SELECT sum(y) FROM d), 9) AS recall FROM w""")
def pr_curve(spark, sf):
    return rounded(metrics.pr_curve(transactions(spark, sf)), skip=("threshold",))


_COST = """CAST(count(*) FILTER (y = 1 AND p >= t) AS BIGINT) AS tp, CAST(count(*) FILTER (y = 0 AND p >= t) AS BIGINT) AS fp,
  CAST(count(*) FILTER (y = 1 AND p < t) AS BIGINT) AS fn,
  coalesce(CAST(sum(am) FILTER (y = 1 AND p < t) AS DOUBLE), 0) AS fn_cost,
  CAST(50 AS DOUBLE) * count(*) FILTER (y = 0 AND p >= t) AS fp_cost, count(*) AS n"""
_COSTED = """SELECT threshold, tp, fp, fn, round(fn_cost, 6) AS fn_cost, fp_cost, round(fn_cost + fp_cost, 6) AS total_cost,
  round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 9) AS precision,
  round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 9) AS recall,
  round(CAST(tp + fp AS DOUBLE) / n, 9) AS block_rate FROM {src}"""


def _money_rounded(df):
    out = rounded(df, skip=("threshold", "fn_cost", "total_cost"))
    return out.withColumns({c: F.round(c, 6) for c in ("fn_cost", "total_cost") if c in df.columns})


@query(f"""WITH {TXN}, {_yp()}, x AS (SELECT CAST(0.56 AS DOUBLE) AS threshold, {_COST} FROM (SELECT *, CAST(0.56 AS DOUBLE) AS t FROM d))
  {_COSTED.format(src='x')}""")
def cost_at(spark, sf):
    return _money_rounded(metrics.cost_at(transactions(spark, sf), 0.56))


@query(f"""WITH {TXN}, {_yp()}, x AS (SELECT CAST(0.3 AS DOUBLE) AS threshold, {_COST},
    (SELECT avg(a) FROM d WHERE y = 1) AS mean_fraud FROM (SELECT *, CAST(0.3 AS DOUBLE) AS t FROM d)),
  z AS (SELECT * EXCLUDE (fn_cost), (mean_fraud + 5) * fn AS fn_cost FROM x) {_COSTED.format(src='z')}""")
def cost_at_average(spark, sf):
    """The other pricing of a missed fraud: average amount plus a fee."""
    return _money_rounded(metrics.cost_at(transactions(spark, sf), 0.3, fee=5.0, mode="average"))


_GRID = "grid AS (SELECT CAST(i AS DOUBLE) / 100 AS t FROM range(1, 100) g(i))"
_SWEEP = f"x AS (SELECT t AS threshold, {_COST} FROM grid CROSS JOIN d GROUP BY t)"


@query(f"WITH {TXN}, {_yp('score_b')}, {_GRID}, {_SWEEP} {_COSTED.format(src='x')}")
def cost_sweep(spark, sf):
    """All 99 thresholds; the score sits exactly on grid values, the hard case for bucketing."""
    return _money_rounded(metrics.cost_sweep(transactions(spark, sf), score="score_b"))


_ACTIVE = """v AS (SELECT *, count(*) OVER (PARTITION BY card_id ORDER BY epoch_us(date)
  RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS card_txns_7d FROM s)"""


def _curve_of(cards: str, where: str) -> str:
    return f"SELECT '{cards}' AS cards, c.* FROM (WITH {_yp('score', 'v', where)}, {_GRID}, {_SWEEP} {_COSTED.format(src='x')}) c"


@query(f"""WITH {TXN}, {split_sql()}, {_ACTIVE} {_curve_of('active', "split = 'test' AND card_txns_7d > 0")}
  UNION ALL {_curve_of('idle', "split = 'test' AND card_txns_7d = 0")}""")
def cost_curve(spark, sf):
    """Flagship: velocity windows, time split, then the cost curves of the test period: of cards active in the week before, and of the others."""
    t = transactions(spark, sf)
    test = materialize(splits.time_split(add_velocity(t), source=t).where("split = 'test'").select("is_fraud", "score", "abs_amount", "card_txns_7d"))
    curve = lambda cards, where: _money_rounded(metrics.cost_sweep(test.where(where))).withColumn("cards", F.lit(cards))
    active, idle = curve("active", "card_txns_7d > 0"), curve("idle", "card_txns_7d = 0")
    if test.where("card_txns_7d = 0").isEmpty():  # no rows, no curve
        return active
    return idle if test.where("card_txns_7d > 0").isEmpty() else active.unionByName(idle)


@query(f"""WITH {TXN}, {_yp()}, {_GRID}, {_SWEEP}, f AS ({_COSTED.format(src='x')})
  SELECT threshold, total_cost FROM f ORDER BY total_cost, threshold LIMIT 1""")
def cost_argmin(spark, sf):
    best = metrics.cheapest(metrics.cost_sweep(transactions(spark, sf)))
    return best.select("threshold", F.round("total_cost", 6).alias("total_cost"))


@query(f"WITH {TXN} SELECT round(CAST(sum(CAST(abs_amount AS DECIMAL(18,6))) AS DOUBLE), 6) AS do_nothing_cost FROM t WHERE is_fraud = 1")
def do_nothing(spark, sf):
    return rounded(metrics.do_nothing(transactions(spark, sf)), 6)


@query(f"""WITH {TXN}, {_yp()}, {_GRID}, {_SWEEP}, f AS ({_COSTED.format(src='x')}),
  b AS (SELECT * FROM f ORDER BY total_cost, threshold LIMIT 1),
  z AS (SELECT round(CAST(sum(am) AS DOUBLE), 6) AS nothing FROM d WHERE y = 1)
  SELECT f.threshold, f.total_cost AS cost, b.threshold AS best_threshold,
    round(f.total_cost - b.total_cost, 6) AS selection_bias, nothing AS do_nothing_cost,
    round(nothing - f.total_cost, 6) AS saved, round(1 - f.total_cost / greatest(nothing, 1), 6) AS avoided_share
  FROM f, b, z WHERE f.threshold = CAST(0.6 AS DOUBLE)""")
def selection_bias(spark, sf):
    return rounded(metrics.savings(transactions(spark, sf), 0.6), 6, skip=("threshold", "best_threshold"))


@query(f"""WITH {TXN}, {_rank('score')} SELECT round({_AP}, 9) AS average_precision,
  round(CAST(sum(pos) AS DOUBLE) / sum(pos + neg), 9) AS base_rate,
  round(({_AP}) / greatest(CAST(sum(pos) AS DOUBLE) / sum(pos + neg), 1e-12), 6) AS lift FROM w""")
def lift_over_base(spark, sf):
    out = metrics.lift_over_base(transactions(spark, sf))
    return rounded(out, skip=("lift",)).withColumn("lift", F.round("lift", 6))


@query(f"""WITH {TXN}, {_yp()}, q AS (SELECT unnest(quantile_cont(p, list_transform(range(0, 21), lambda i: i / CAST(20 AS DOUBLE)))) AS e FROM d),
  e AS (SELECT list_sort(list_distinct(list(e))) AS es FROM q),
  b AS (SELECT p, y, len(list_filter(es[2:len(es)-1], lambda v: v <= p)) AS bin FROM d, e),
  m AS (SELECT bin, count(*) AS n, avg(p) AS s, avg(y) AS y FROM b GROUP BY bin)
  SELECT round(sum(n * abs(s - y)) / sum(n), 8) AS ece FROM m""")
def calibration_error(spark, sf):
    return rounded(metrics.calibration_error(transactions(spark, sf)), 8)


@query(f"""WITH {TXN}, {_yp()}, q AS (SELECT round(greatest(least(quantile_cont(p, CAST(0.998 AS DOUBLE)), 0.9 * CAST(0.99 AS DOUBLE)), 0), 6) AS r FROM d)
  SELECT r AS review_threshold, round(avg(CAST(p >= r AS INTEGER)), 9) AS share FROM d, q GROUP BY r""")
def review_threshold(spark, sf):
    t = transactions(spark, sf)
    r = metrics.review_threshold(t, 0.9)
    return rounded(metrics.band_share(t, r)).withColumn("review_threshold", F.lit(r))


def _predictions(spark, sf):
    t = transactions(spark, sf)
    blend = blending.blend({"a": F.col("score"), "b": F.col("score_b")}, {"a": 0.8, "b": 0.2})
    models = F.array(*[F.struct(F.lit(n).alias("model"), c.alias("score"))
                       for n, c in (("a", F.col("score")), ("b", F.col("score_b")), ("ensemble", blend))])
    return t.select("id", "is_fraud", "abs_amount", F.inline(models))


_PRED = """pr AS (SELECT 'a' AS model, is_fraud AS y, score AS p, abs_amount AS a FROM t
  UNION ALL SELECT 'b', is_fraud, score_b, abs_amount FROM t
  UNION ALL SELECT 'ensemble', is_fraud, (CAST(0.8 AS DOUBLE) * score + CAST(0.2 AS DOUBLE) * score_b) / CAST(1.0 AS DOUBLE), abs_amount FROM t)"""


@query(f"""WITH {TXN}, {_PRED}, d AS (SELECT *, CAST(a AS DECIMAL(18,6)) AS am FROM pr),
  c AS (SELECT model, {CONFUSION.format(t='CAST(0.5 AS DOUBLE)')},
    coalesce(CAST(sum(am) FILTER (y = 1 AND p < CAST(0.5 AS DOUBLE)) AS DOUBLE), 0)
      + 50 * count(*) FILTER (y = 0 AND p >= CAST(0.5 AS DOUBLE)) AS total_cost FROM d GROUP BY model),
  g AS (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM d GROUP BY model, p),
  w AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY p DESC) AS cp,
    sum(neg) OVER (PARTITION BY model ORDER BY p DESC) AS cn FROM g),
  k AS (SELECT model, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
    round({_AP}, 9) AS average_precision, round({_AUC}, 9) AS roc_auc FROM w GROUP BY model),
  q AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS pp, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS rr FROM c)
  SELECT model, tn, fp, fn, tp, round(pp, 9) AS precision, round(rr, 9) AS recall,
    round(coalesce(2.0 * pp * rr / nullif(pp + rr, 0), 0), 9) AS f1, round(total_cost, 6) AS total_cost,
    positives, negatives, average_precision, roc_auc FROM q JOIN k USING (model)""")
def leaderboard(spark, sf):
    out = metrics.leaderboard(_predictions(spark, sf), 0.5)
    return rounded(out, skip=("total_cost",)).withColumn("total_cost", F.round("total_cost", 6))


@query(f"""WITH {TXN}, {_PRED.replace("'a' AS model, is_fraud AS y", "'a' AS model, id, is_fraud AS y").replace("SELECT 'b', ", "SELECT 'b', id, ").replace("SELECT 'ensemble', ", "SELECT 'ensemble', id, ")}
  SELECT id, max(p) FILTER (model = 'a') AS a, max(p) FILTER (model = 'b') AS b, max(p) FILTER (model = 'ensemble') AS ensemble
  FROM pr GROUP BY id""")
def aligned_predictions(spark, sf):
    """Predictions of several models side by side, matched by row id."""
    base, long = scratch(spark, "predictions"), _predictions(spark, sf)
    for name in ("a", "b", "ensemble"):
        sinks.write_predictions(long.where(F.col("model") == name).select("id", F.lit("val_fit").alias("split"), "is_fraud", "abs_amount", "score"), base, name)
    return train.aligned(spark, base, ["a", "b", "ensemble"]).select("id", "a", "b", "ensemble")


@query(f"""WITH {TXN}, p AS (SELECT id, (CAST(0.8 AS DOUBLE) * score + CAST(0.2 AS DOUBLE) * score_b) / CAST(1.0 AS DOUBLE) AS raw_score FROM t)
  SELECT id, round(raw_score, 9) AS raw_score, round(CASE WHEN raw_score <= 0.5 THEN raw_score / 2 ELSE 0.25 + (raw_score - 0.5) * 1.5 END, 9) AS score FROM p""")
def shipped_val_scores(spark, sf):
    """Stored scores of two members through the stored blend and the stored calibrator, as the context stage reads them."""
    base, long = scratch(spark, "shipped"), _predictions(spark, sf)
    for name, model in (("gbt", "a"), ("linear", "b")):
        sinks.write_predictions(long.where(F.col("model") == model).select("id", F.lit("val_fit").alias("split"), "is_fraud", "abs_amount", "score"), f"{base}/val_scores", name)
    sinks.write_document(spark, f"{base}/serving_config", {"shipped_model": "ensemble", "ensemble_weights": {"gbt": 0.8, "linear": 0.2, "forest": 0.0}})
    sinks.write_small(spark.createDataFrame([(0.0, 0.0), (0.5, 0.25), (1.0, 1.0)], "x double, y double"), f"{base}/calibrator")
    return reference.shipped_scores(spark, base).select("id", F.round("raw_score", 9).alias("raw_score"), F.round("score", 9).alias("score"))


@query()
def bootstrap_interval(spark, sf):
    return bootstrap.ap_interval(transactions(spark, sf))


@query()
def paired_bootstrap(spark, sf):
    return bootstrap.paired_delta(transactions(spark, sf), "score", "score_b")


# ----------------------------------------------------------------------------- weights


@query(f"""WITH {TXN}, a AS (SELECT CAST(count(*) - sum(is_fraud) AS DOUBLE) / greatest(sum(is_fraud), 1) AS spw FROM t)
  SELECT id, round(CASE WHEN is_fraud = 1 THEN spw ELSE 1 END, 9) AS class_weight FROM t, a""")
def class_weights(spark, sf):
    return weights.class_weight(transactions(spark, sf)).select("id", F.round("class_weight", 9).alias("class_weight"))


_AGE = "(epoch_us((SELECT max(date) FROM t)) - epoch_us(date)) / 86400000000.0"


@query(f"WITH {TXN} SELECT id, round(power(0.5, {_AGE} / 10.0), 9) AS recency_weight FROM t")
def recency_weights(spark, sf):
    return weights.recency_weight(transactions(spark, sf), 10).select(
        "id", F.round("recency_weight", 9).alias("recency_weight"))


_COMBINED = f"""a AS (SELECT CAST(count(*) - sum(is_fraud) AS DOUBLE) / greatest(sum(is_fraud), 1) AS spw FROM t),
  rw AS (SELECT id, is_fraud, (CASE WHEN is_fraud = 1 THEN spw ELSE 1 END) * power(0.5, {_AGE} / 10.0) AS w0 FROM t, a),
  cw AS (SELECT id, is_fraud, w0 / (SELECT avg(w0) FROM rw) AS w FROM rw)"""


@query(f"WITH {TXN}, {_COMBINED} SELECT id, round(w, 7) AS weight FROM cw")
def combined_weights(spark, sf):
    return weights.combined_weight(transactions(spark, sf), 10).select("id", F.round("weight", 7).alias("weight"))


@query(f"WITH {TXN}, {_COMBINED} SELECT round(sum(w) * sum(w) / sum(w * w), 4) AS effective_rows FROM cw")
def effective_sample_size(spark, sf):
    return rounded(weights.effective_sample_size(weights.combined_weight(transactions(spark, sf), 10)), 4)


@query(f"""WITH {TXN}, h AS (SELECT unnest([0, 5, 10, 30, 60]) AS half_life),
  w AS (SELECT half_life, CASE WHEN half_life > 0 THEN power(0.5, {_AGE} / nullif(half_life, 0)) ELSE 1 END AS w FROM t, h)
  SELECT CAST(half_life AS INTEGER) AS half_life, round(sum(w) * sum(w) / sum(w * w), 4) AS effective_rows FROM w GROUP BY 1""")
def half_life_sweep(spark, sf):
    return rounded(weights.half_life_sweep(transactions(spark, sf), [0, 5, 10, 30, 60]), 4)


# -------------------------------------------------------------------- blending, calibration


@query(f"""WITH {TXN} SELECT id, round((CAST(0.7 AS DOUBLE) * score + CAST(0.3 AS DOUBLE) * score_b) / 1.0, 9) AS blended,
  round((score + score_b) / 2, 9) AS plain_mean FROM t""")
def blend_scores(spark, sf):
    cols = {"a": F.col("score"), "b": F.col("score_b")}
    return transactions(spark, sf).select(
        "id", F.round(blending.blend(cols, {"a": 0.7, "b": 0.3}), 9).alias("blended"),
        F.round(blending.blend(cols, {}), 9).alias("plain_mean"))


_THIRD = "CAST((id * 53) % 97 AS DOUBLE) / 97"


@query(f"""WITH {TXN}, {split_sql()}, {_VAL}, f AS (SELECT is_fraud AS y, score AS a, score_b AS b, {_THIRD} AS c FROM p WHERE split = 'val_fit'),
  pts AS (SELECT i, j, 10 - i - j AS k FROM range(0, 11) g(i), range(0, 11) h(j) WHERE i + j <= 10),
  x AS (SELECT i, j, k, y, CAST(i AS DOUBLE) / 10 * a + CAST(j AS DOUBLE) / 10 * b + CAST(k AS DOUBLE) / 10 * c AS p FROM pts, f),
  g AS (SELECT i, j, k, p, sum(y) AS pos, sum(1 - y) AS neg FROM x GROUP BY i, j, k, p),
  w AS (SELECT *, sum(pos) OVER (PARTITION BY i, j, k ORDER BY p DESC) AS cp, sum(neg) OVER (PARTITION BY i, j, k ORDER BY p DESC) AS cn FROM g)
  SELECT CAST(i AS DOUBLE) / 10 AS w_a, CAST(j AS DOUBLE) / 10 AS w_b, CAST(k AS DOUBLE) / 10 AS w_c, round({_AP}, 9) AS average_precision
  FROM w GROUP BY i, j, k""")
def blend_search(spark, sf):
    """All 66 blends of three scores, ranked on val_fit rows only."""
    p = splits.val_cut(splits.time_split(transactions(spark, sf))).where("split = 'val_fit'")
    third = ((F.col("id") * 53) % 97).cast("double") / 97
    grid = blending.blend_grid(p.withColumn("third", third), ["score", "score_b", "third"])
    w = F.col("weights")
    return grid.select(w[0].alias("w_a"), w[1].alias("w_b"), w[2].alias("w_c"),
                       F.round("average_precision", 9).alias("average_precision"))


@query(f"""WITH {TXN}, p AS (SELECT CAST(i AS DOUBLE) / 10 AS a, CAST(j AS DOUBLE) / 10 AS b, CAST(10 - i - j AS DOUBLE) / 10 AS c
  FROM range(0, 11) g(i), range(0, 11) h(j) WHERE i + j <= 10)
  SELECT a, b, c, count(*) FILTER (WHERE a * score + b * score_b + c * (k / CAST(100 AS DOUBLE)) >= 0.5000001) AS blocked FROM p, t GROUP BY ALL""")
def simplex_points(spark, sf):
    """How many rows each point of the blend grid would block: one pass, one counter for each point."""
    t = transactions(spark, sf)
    points = [tuple(float(x) for x in r["weights"]) for r in blending.simplex(spark, 3).collect()]  # 66 fixed points
    blocked = [F.count_if(F.lit(a) * F.col("score") + F.lit(b) * F.col("score_b") + F.lit(c) * (F.col("k") / 100) >= 0.5000001) for a, b, c in points]
    counted = t.agg(F.array(*blocked).alias("n"))
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.get("n", F.lit(i)).alias("blocked")) for i, (a, b, c) in enumerate(points)])
    return counted.select(F.inline(rows))


@query(f"""WITH {TXN}, q AS (SELECT unnest(quantile_cont(score, list_transform(range(0, 11), lambda i: i / CAST(10 AS DOUBLE)))) AS x FROM t),
  k AS (SELECT x, x * x AS y, lead(x) OVER (ORDER BY x) AS x2, lead(x * x) OVER (ORDER BY x) AS y2 FROM (SELECT DISTINCT x FROM q)),
  m AS (SELECT min(x) AS lo, max(x) AS hi FROM k)
  SELECT id, round(CASE WHEN s <= lo THEN lo * lo WHEN s >= hi THEN hi * hi ELSE y + (y2 - y) / (x2 - x) * (s - x) END, 9) AS calibrated
  FROM (SELECT id, score * 1.05 AS s FROM t) t2 CROSS JOIN m LEFT JOIN k ON s >= x AND s < x2""")
def calibrate_apply(spark, sf):
    """Piecewise-linear calibration through decile knots, including scores beyond the last knot."""
    from riskloom.operators.ordering import quantile_list

    t = transactions(spark, sf)
    xs = sorted(set(quantile_list(t, "score", [i / 10 for i in range(11)])))
    point = OperatingPoint(calibrator="isotonic", knots_x=tuple(xs), knots_y=tuple(x * x for x in xs))
    out = calibrate(t.withColumn("raw", F.col("score") * 1.05), point, "raw", "calibrated")
    return out.select("id", F.round("calibrated", 9).alias("calibrated"))


@query(f"""WITH {TXN}, {split_sql()}, {_VAL}, g AS (SELECT score AS x, CAST(sum(is_fraud) AS DOUBLE) AS y, count(*) AS w FROM p WHERE split = 'val_fit' GROUP BY score),
  c AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(y) OVER (ORDER BY x) AS cy, sum(w) OVER (ORDER BY x) AS cw FROM g),
  c0 AS (SELECT i, cy, cw FROM c UNION ALL SELECT 0, 0, 0),
  lo AS (SELECT a.i AS a, e.i AS e, (e.cy - a.cy) / (e.cw - a.cw) AS m FROM c0 a JOIN c e ON e.i > a.i),
  mn AS (SELECT a, e AS i, min(m) OVER (PARTITION BY a ORDER BY e DESC) AS m FROM lo),
  iso AS (SELECT i, max(m) AS v FROM mn GROUP BY i),
  pts AS (SELECT x, v, lead(x) OVER (ORDER BY x) AS x2, lead(v) OVER (ORDER BY x) AS v2 FROM c JOIN iso USING (i)),
  q AS (SELECT quantile_cont(score, list_transform(range(0, 512), lambda j: j / CAST(511 AS DOUBLE))) AS ks FROM p WHERE split = 'val_fit'),
  k AS (SELECT DISTINCT unnest(ks) AS x FROM q)
  SELECT round(k.x, 8) AS x, round(CASE WHEN k.x = pts.x OR x2 IS NULL THEN v ELSE v + (v2 - v) / (x2 - pts.x) * (k.x - pts.x) END, 6) AS y
  FROM k ASOF JOIN pts ON k.x >= pts.x""")
def isotonic_fit(spark, sf):
    """Isotonic calibration fitted on val_fit: its knots."""
    p = splits.val_cut(splits.time_split(transactions(spark, sf))).where("split = 'val_fit'")
    xs, ys = blending.fit_isotonic(p)
    knots = spark.createDataFrame(list(zip(xs, ys)), "x double, y double")
    return knots.select(F.round("x", 8).alias("x"), F.round("y", 6).alias("y"))


# ---------------------------------------------------------------- analyses from the docs


@query(f"""WITH {TXN}, {split_sql()} SELECT split, mcc_category AS level, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS frauds,
  round(avg(is_fraud), 9) AS rate, round(CAST(sum(is_fraud) AS DOUBLE) / nullif(sum(sum(is_fraud)) OVER (PARTITION BY split), 0), 9) AS share
  FROM s GROUP BY split, mcc_category""")
def fraud_concentration(spark, sf):
    """Where fraud sits: share of all fraud and rate inside each value, per split."""
    from pyspark.sql import Window

    s = splits.time_split(transactions(spark, sf))
    g = s.groupBy("split", F.col("mcc_category").alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_fraud").cast("bigint").alias("frauds"), F.avg("is_fraud").alias("rate"))
    total = F.nullif(F.sum("frauds").over(Window.partitionBy("split")).cast("double"), F.lit(0.0))
    return rounded(g.withColumn("share", F.col("frauds") / total))


_VELO = ["card_txns_1h", "card_txns_24h", "card_txns_7d", "card_amount_24h"]


@query(f"""WITH {TXN}, v AS (SELECT is_fraud, count(*) OVER (PARTITION BY card_id ORDER BY epoch_us(date) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS card_txns_1h,
   count(*) OVER (PARTITION BY card_id ORDER BY epoch_us(date) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS card_txns_24h,
   count(*) OVER (PARTITION BY card_id ORDER BY epoch_us(date) RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS card_txns_7d,
   CAST(coalesce(sum(CAST(abs_amount AS DECIMAL(18,6))) OVER (PARTITION BY card_id ORDER BY epoch_us(date) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS card_amount_24h FROM t),
  u AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, is_fraud FROM v" for c in _VELO)})
  SELECT feature, round(avg(v) FILTER (is_fraud = 1), 6) AS fraud_mean, round(avg(v) FILTER (is_fraud = 0), 6) AS legit_mean,
    round(avg(v) FILTER (is_fraud = 1) / nullif(avg(v) FILTER (is_fraud = 0), 0), 6) AS ratio FROM u GROUP BY feature""")
def velocity_contrast(spark, sf):
    """Mean of each velocity column for fraud against legitimate rows."""
    v = add_velocity(transactions(spark, sf))
    long = v.select("is_fraud", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in _VELO])))
    m = lambda y: F.avg(F.when(F.col("is_fraud") == y, F.col("v")))
    g = long.groupBy("feature").agg(m(1).alias("fraud_mean"), m(0).alias("legit_mean"))
    return rounded(g.withColumn("ratio", F.col("fraud_mean") / F.nullif(F.col("legit_mean"), F.lit(0.0))), 6)


@query(f"WITH {TXN} SELECT round(corr(score, score_b), 9) AS correlation FROM t")
def score_correlation(spark, sf):
    return transactions(spark, sf).agg(F.round(F.corr("score", "score_b"), 9).alias("correlation"))


@query(f"""WITH {TXN} SELECT count(DISTINCT score) AS raw_values, count(DISTINCT floor(score * 20)) AS coarse_values FROM t""")
def distinct_scores(spark, sf):
    """Distinct values before and after a map with flat steps: what a calibrator does to ties."""
    t = transactions(spark, sf)
    n = lambda c: t.groupBy(c.alias("v")).agg(F.lit(1).alias("x")).agg(F.count("x")).scalar()
    return read(spark, sf, "region").limit(1).select(
        n(F.col("score")).alias("raw_values"), n(F.floor(F.col("score") * 20)).alias("coarse_values"))


@query(f"""WITH {TXN}, {split_sql()}, f AS (SELECT 'mcc_category' AS feature, mcc_category AS level, is_fraud AS y, split FROM s
   UNION ALL SELECT 'use_chip', use_chip, is_fraud, split FROM s UNION ALL SELECT 'k_decile', CAST(k // 10 AS VARCHAR), is_fraud, split FROM s),
  rt AS (SELECT feature, level, avg(y) AS rate FROM f WHERE split = 'train' GROUP BY 1, 2),
  d AS (SELECT f.feature, y, coalesce(rate, 0) AS p FROM f LEFT JOIN rt ON f.feature = rt.feature AND f.level = rt.level WHERE split = 'test'),
  g AS (SELECT feature, p, sum(y) AS pos, sum(1 - y) AS neg FROM d GROUP BY feature, p),
  w AS (SELECT *, sum(pos) OVER (PARTITION BY feature ORDER BY p DESC) AS cp, sum(neg) OVER (PARTITION BY feature ORDER BY p DESC) AS cn FROM g)
  SELECT feature, round({_AP}, 9) AS average_precision FROM w GROUP BY feature""")
def single_feature_power(spark, sf):
    """How well one column alone ranks fraud: its training rate per level, scored on test rows."""
    from riskloom.operators.skew import left_lookup

    s = splits.time_split(transactions(spark, sf))
    names = {"mcc_category": F.col("mcc_category"), "use_chip": F.col("use_chip"),
             "k_decile": F.floor(F.col("k") / 10).cast("string")}
    long = s.select("split", "is_fraud", F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), c.alias("level")) for n, c in names.items()])))
    long = long.withColumn("fl", F.concat_ws("=", "feature", "level"))
    rates = long.where("split = 'train'").groupBy("fl").agg(F.avg("is_fraud").alias("score"))
    test = left_lookup(long.where("split = 'test'"), rates, "fl").na.fill(0.0, ["score"])
    return rounded(metrics.average_precision(test, by=["feature"]))
