"""Ranking quality, money lost and calibration error over (label, score, amount) columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.lookup import locate
from riskloom.operators.ordering import quantile_list, running_totals
from riskloom.schema import LABEL

# The cost model and the reviewer capacity.
FP_COST = 50.0
FN_COST_MODE = "amount"
CHARGEBACK_FEE = 0.0
REVIEW_CAPACITY_RATE = 0.002

MONEY = "decimal(18,6)"


def _count(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("bigint")), F.lit(0)).cast("bigint")


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)), F.lit(0.0))


def precision(tp: str = "tp", fp: str = "fp") -> Column:
    return _ratio(F.col(tp), F.col(tp) + F.col(fp))


def recall(tp: str = "tp", fn: str = "fn") -> Column:
    return _ratio(F.col(tp), F.col(tp) + F.col(fn))


def confusion(df: DataFrame, threshold: float, score: str = "score", label: str = LABEL,
              by: Sequence[str] = ()) -> DataFrame:
    hit, bad = F.col(score) >= F.lit(float(threshold)), F.col(label) == 1
    return df.groupBy(*by).agg(
        _count(~hit & ~bad).alias("tn"), _count(hit & ~bad).alias("fp"),
        _count(~hit & bad).alias("fn"), _count(hit & bad).alias("tp"),
    )


def prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 from confusion counts; an undefined ratio is 0."""
    p, r = precision(), recall()
    return counts.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", _ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def score_groups(df: DataFrame, score: str = "score", label: str = LABEL, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score with its positives and negatives (combined map-side)."""
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"),
        F.sum((1 - F.col(label)).cast("bigint")).alias("neg"),
    )


def ranked_groups(df: DataFrame, score: str = "score", label: str = LABEL, by: Sequence[str] = ()) -> DataFrame:
    return running_totals(score_groups(df, score, label, by), "score", ["pos", "neg"], by, descending=True)


def pr_curve(df: DataFrame, score: str = "score", label: str = LABEL, by: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score: precision and recall of flagging everything at or above it."""
    ranked = ranked_groups(df, score, label, by)
    total = df.groupBy(*by).agg(F.sum(F.col(label).cast("bigint")).alias("all_pos"))
    joined = ranked.join(total, list(by)) if by else ranked.withColumn("all_pos", total.select("all_pos").scalar())
    return joined.select(
        *by, F.col("score").alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        _ratio(F.col("cum_pos"), F.col("all_pos")).alias("recall"),
    )


def rank_quality(df: DataFrame, score: str = "score", label: str = LABEL, by: Sequence[str] = ()) -> DataFrame:
    """Average precision and ROC-AUC over distinct scores, exact under ties, in one ranking pass.

    Average precision is the step sum of precision over recall gains. ROC-AUC counts the
    (positive, negative) pairs ranked the right way, a tie counting one half.
    """
    ranked = ranked_groups(df, score, label, by)
    pos, neg, cp, cn = (F.col(c).cast("double") for c in ("pos", "neg", "cum_pos", "cum_neg"))
    sums = ranked.groupBy(*by).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        F.sum(pos * cp / (cp + cn)).alias("_steps"),
        F.sum(neg * (cp - pos) + neg * pos / 2).alias("_pairs"),
    )
    return sums.select(
        *by, F.col("positives").cast("bigint"), F.col("negatives").cast("bigint"),
        _ratio(F.col("_steps"), F.col("positives")).alias("average_precision"),
        (F.col("_pairs") / F.nullif(F.col("positives").cast("double") * F.col("negatives").cast("double"),
                                    F.lit(0.0))).alias("roc_auc"),
    )


def average_precision(df: DataFrame, score: str = "score", label: str = LABEL, by: Sequence[str] = ()) -> DataFrame:
    return rank_quality(df, score, label, by).select(*by, "average_precision")


def ap_value(df: DataFrame, score: str = "score", label: str = LABEL) -> float:
    return average_precision(df, score, label).first()[0]


# ------------------------------------------------------------------ money


def _price(counts: DataFrame, fp_cost: float, fee: float, mode: str) -> DataFrame:
    missed = F.col("fn_amount").cast("double")
    if mode == "average":
        missed = F.coalesce(F.col("fraud_amount").cast("double") / F.nullif(
            (F.col("tp") + F.col("fn")).cast("double"), F.lit(0.0)), F.lit(0.0)) * F.col("fn")
    return (
        counts.withColumn("fn_cost", missed + F.lit(fee) * F.col("fn"))
        .withColumn("fp_cost", F.lit(fp_cost) * F.col("fp"))
        .select(
            "threshold", "tp", "fp", "fn", "fn_cost", "fp_cost",
            (F.col("fn_cost") + F.col("fp_cost")).alias("total_cost"),
            precision().alias("precision"), recall().alias("recall"),
            _ratio(F.col("tp") + F.col("fp"), F.col("n")).alias("block_rate"),
        )
    )


def _money(cond: Column, amount: str) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(amount).cast(MONEY))), F.lit(0).cast(MONEY))


def cost_at(df: DataFrame, threshold: float, score: str = "score", label: str = LABEL,
            amount: str = "abs_amount", fp_cost: float = FP_COST, fee: float = CHARGEBACK_FEE,
            mode: str = FN_COST_MODE) -> DataFrame:
    """Money lost at one threshold: a missed fraud costs its amount, a wrong block a flat fee."""
    hit, bad = F.col(score) >= F.lit(float(threshold)), F.col(label) == 1
    counts = df.agg(
        _count(hit & bad).alias("tp"), _count(hit & ~bad).alias("fp"), _count(~hit & bad).alias("fn"),
        _money(~hit & bad, amount).alias("fn_amount"), _money(bad, amount).alias("fraud_amount"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("threshold", F.lit(float(threshold)))
    return _price(counts, fp_cost, fee, mode)


def threshold_grid(lo: float = 0.01, hi: float = 0.99, step: float = 0.01) -> list[float]:
    n = int((hi + 1e-9 - lo) / step) + 1
    return [round(lo + i * step, 4) for i in range(n)]


def cost_sweep(df: DataFrame, grid: Sequence[float] | None = None, score: str = "score", label: str = LABEL,
               amount: str = "abs_amount", fp_cost: float = FP_COST, fee: float = CHARGEBACK_FEE,
               mode: str = FN_COST_MODE) -> DataFrame:
    """Every threshold of the grid from one pass over the rows.

    A row falls into the cell between two neighbouring thresholds; the curve is the running
    total over at most ``len(grid) + 1`` cells.
    """
    grid = list(grid or threshold_grid())
    bad = F.col(label) == 1
    placed = locate(df.select(score, label, amount), grid, score, "cell")
    cells = placed.groupBy("cell").agg(
        _count(bad).alias("pos"), _count(~bad).alias("neg"), _money(bad, amount).alias("money"))
    spark = df.sparkSession
    steps = spark.createDataFrame([(i, t) for i, t in enumerate([None, *grid])], "cell int, threshold double")
    table = steps.join(F.broadcast(cells), "cell", "left").na.fill(0, ["pos", "neg"]).withColumn(
        "money", F.coalesce("money", F.lit(0).cast(MONEY)))
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    counts = table.select(
        "threshold",
        F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        zero(F.sum("pos").over(below)).cast("bigint").alias("fn"),
        zero(F.sum("money").over(below)).alias("fn_amount"),
        F.sum("money").over(every).alias("fraud_amount"),
        F.sum(F.col("pos") + F.col("neg")).over(every).alias("n"),
    ).where(F.col("threshold").isNotNull())
    return _price(counts, fp_cost, fee, mode)


def cheapest(sweep: DataFrame) -> DataFrame:
    """The sweep row with the lowest total cost; the lowest threshold wins a tie."""
    return sweep.orderBy("total_cost", "threshold").limit(1)


def do_nothing(df: DataFrame, label: str = LABEL, amount: str = "abs_amount",
               fee: float = CHARGEBACK_FEE) -> DataFrame:
    bad = F.col(label) == 1
    return df.agg((_money(bad, amount).cast("double") + F.lit(fee) * _count(bad)).alias("do_nothing_cost"))


def savings(df: DataFrame, threshold: float, score: str = "score", label: str = LABEL,
            amount: str = "abs_amount") -> DataFrame:
    """What a threshold saves, and what choosing it on the same rows would have flattered."""
    chosen = cost_at(df, threshold, score, label, amount)
    best = cheapest(cost_sweep(df, None, score, label, amount))
    nothing = do_nothing(df, label, amount)
    return chosen.select(
        "threshold", F.col("total_cost").alias("cost"),
        best.select("threshold").scalar().alias("best_threshold"),
        (F.col("total_cost") - best.select("total_cost").scalar()).alias("selection_bias"),
        nothing.scalar().alias("do_nothing_cost"),
    ).withColumns({
        "saved": F.col("do_nothing_cost") - F.col("cost"),
        "avoided_share": 1 - F.col("cost") / F.greatest(F.col("do_nothing_cost"), F.lit(1.0)),
    })


def lift_over_base(df: DataFrame, score: str = "score", label: str = LABEL) -> DataFrame:
    q = rank_quality(df, score, label)
    base = F.col("positives") / (F.col("positives") + F.col("negatives"))
    return q.select("average_precision", base.alias("base_rate"),
                    (F.col("average_precision") / F.greatest(base, F.lit(1e-12))).alias("lift"))


# ------------------------------------------------------------ calibration error, review band


def calibration_error(df: DataFrame, score: str = "score", label: str = LABEL, bins: int = 20) -> DataFrame:
    """Mean |predicted - observed| over equal-count bins with distinct edges."""
    edges = sorted(set(quantile_list(df, score, [i / bins for i in range(bins + 1)])))
    if len(edges) < 2:
        return df.limit(1).select(F.lit(None).cast("double").alias("ece"))
    placed = locate(df.select(score, label), edges[1:-1], score, "bin")
    per_bin = placed.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("s"), F.avg(label).alias("y"))
    return per_bin.agg((F.sum(F.col("n") * F.abs(F.col("s") - F.col("y"))) / F.sum("n")).alias("ece"))


def review_threshold(df: DataFrame, block: float, score: str = "score",
                     rate: float = REVIEW_CAPACITY_RATE) -> float:
    """Lower edge of the review band: the score that sends ``rate`` of traffic to a reviewer."""
    (q,) = quantile_list(df, score, [1.0 - rate])
    return round(max(min(q, block * 0.99), 0.0), 6)


def band_share(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return df.agg(F.avg((F.col(score) >= threshold).cast("int")).alias("share"))


def leaderboard(predictions: DataFrame, threshold: float, label: str = LABEL, amount: str = "abs_amount") -> DataFrame:
    """Per model: rank quality, confusion and cost at one threshold. Input: (model, label, score, amount)."""
    quality = rank_quality(predictions, "score", label, ["model"])
    hit, bad = F.col("score") >= threshold, F.col(label) == 1
    counts = predictions.groupBy("model").agg(
        _count(~hit & ~bad).alias("tn"), _count(hit & bad).alias("tp"), _count(hit & ~bad).alias("fp"),
        _count(~hit & bad).alias("fn"), _money(~hit & bad, amount).alias("fn_amount"))
    cost = F.col("fn_amount").cast("double") + FP_COST * F.col("fp")
    return prf(counts).withColumn("total_cost", cost).drop("fn_amount").join(quality, "model")
