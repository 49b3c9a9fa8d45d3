"""The evaluation protocol: choose on val_fit, set thresholds on val_sel, look at test once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import blending, bootstrap, metrics
from riskloom.operators.decisions import MODEL_VERSION, OperatingPoint, calibrate
from riskloom.plans.modelling import Fitted, only, predict
from riskloom.schema import LABEL
from riskloom.sources import sinks
from riskloom.sources.shared import materialize

SPLITS = ("val_fit", "val_sel", "test", "demo")


@dataclass
class Assessment:
    point: OperatingPoint
    weights: dict[str, float]
    report: dict
    board: DataFrame
    sweep: DataFrame
    scored_val: DataFrame
    predictions: DataFrame
    extras: dict = field(default_factory=dict)


def predict_all(members: dict[str, Fitted], rows: DataFrame) -> DataFrame:
    """(id, split, label, amount, one column per member), written once: every metric reads it."""
    kept = only(rows, *SPLITS)
    out = kept
    for name, fitted in members.items():
        out = predict(fitted, out, name)
    return materialize(out.select("id", "split", LABEL, "abs_amount", *members))


def add_blend(predictions: DataFrame, members: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """Blend weights found on val_fit; only members with weight take part."""
    weights = blending.best_blend(predictions.where("split = 'val_fit'"), members)
    used = {m: F.col(m) for m in members if weights.get(m, 0) > 0}
    return predictions.withColumn("ensemble", blending.blend(used, weights)), weights


def _long(df: DataFrame, models: list[str]) -> DataFrame:
    return df.select("id", LABEL, "abs_amount", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in models])))


def run(predictions: DataFrame, members: list[str], ship: str | None = None, n_boot: int = 500) -> Assessment:
    """``ship`` pins the served model; otherwise the best one on val_fit ships."""
    scored, weights = add_blend(predictions, members)
    models = [*members, "ensemble"]
    part = {s: scored.where(F.col("split") == s) for s in SPLITS}

    # 1. Which model ships: average precision on val_fit.
    on_fit = {r["model"]: r["average_precision"] for r in
              metrics.rank_quality(_long(part["val_fit"], models), by=["model"]).collect()}
    best = min((m for m in models if on_fit[m] == max(on_fit.values())), key=models.index)
    shipped = ship if ship in on_fit else best

    # 2. Its calibration, fitted on val_fit and measured on val_sel.
    served = lambda df: df.withColumn("raw_score", F.col(shipped))
    xs, ys = blending.fit_isotonic(part["val_fit"], shipped)
    curve = OperatingPoint(model=shipped, calibrator="isotonic", knots_x=tuple(xs), knots_y=tuple(ys))
    calibrated = lambda df: calibrate(served(df), curve, "raw_score", "score")
    sel = materialize(calibrated(part["val_sel"]))
    before = metrics.calibration_error(served(part["val_sel"]), "raw_score").first()[0]
    after = metrics.calibration_error(sel, "score").first()[0]

    # 3. Thresholds on calibrated val_sel.
    block = metrics.cheapest(metrics.cost_sweep(sel)).first()["threshold"]
    review = metrics.review_threshold(sel, block)
    point = OperatingPoint(block, review, shipped, MODEL_VERSION, "isotonic", tuple(xs), tuple(ys), shipped)

    # 4. Test, once. Ranks use uncalibrated scores for every model; costs use what is served.
    test = materialize(calibrated(part["test"]))
    board = metrics.leaderboard(_long(test, models), 0.5).withColumns({
        "shipped": F.col("model") == shipped, "best_on_val_fit": F.col("model") == best})
    sweep = metrics.cost_sweep(test)
    chosen = metrics.cost_at(test, block).first().asDict()
    oracle = metrics.cheapest(sweep).first().asDict()
    nothing = metrics.do_nothing(test).first()[0] or 0.0
    interval = bootstrap.ap_interval(test, shipped, n_boot=n_boot).first().asDict()
    single = max(members, key=lambda m: on_fit[m])
    delta = bootstrap.paired_delta(test, single, "ensemble", n_boot=n_boot).first().asDict()

    # 5. The period after test, reported apart.
    demo = calibrated(part["demo"])
    check = {**metrics.cost_at(demo, block).first().asDict(), **metrics.rank_quality(demo).first().asDict()}
    base = test.agg(F.count(F.lit(1)), F.sum(LABEL)).first()
    report = {
        "model_version": MODEL_VERSION, "shipped": shipped, "best_on_val_fit": best,
        "shipped_by_override": shipped != best, "selected_on": "val_fit", "threshold_selected_on": "val_sel",
        "val_fit_average_precision": on_fit, "calibration": {"method": "isotonic", "ece_before": before, "ece_after": after},
        "cost_model": {"fp_cost_per_block": metrics.FP_COST, "fn_cost_mode": metrics.FN_COST_MODE,
                       "chargeback_fee": metrics.CHARGEBACK_FEE},
        "cost_optimal": chosen, "cost_oracle_test_argmin": oracle,
        "selection_bias": chosen["total_cost"] - oracle["total_cost"], "do_nothing_cost": nothing,
        "saved": nothing - chosen["total_cost"], "avoided_share": 1 - chosen["total_cost"] / max(nothing, 1.0),
        "review_band": [review, block], "ensemble_weights": weights,
        "test_interval": interval, "ensemble_vs_best_single": {"best_single": single, **delta},
        "test_rows": base[0], "test_frauds": base[1], "test_random_baseline": (base[1] or 0) / max(base[0], 1),
        "check_set": check,
    }
    val = calibrated(scored.where(F.col("split").isin("val_fit", "val_sel")))
    return Assessment(point, weights, report, board, sweep, val, scored)


def save(a: Assessment, path: str) -> None:
    spark = a.board.sparkSession
    sinks.write_document(spark, f"{path}/assessment", a.report)
    sinks.write_small(a.sweep, f"{path}/threshold_sweep", "csv")
    sinks.write_small(a.board, f"{path}/leaderboard", "json")
    sinks.write_small(spark.createDataFrame(list(zip(a.point.knots_x, a.point.knots_y)), "x double, y double"),
                      f"{path}/calibrator")
    sinks.write_document(spark, f"{path}/serving_config", {
        "shipped_model": a.point.model, "ensemble_weights": a.weights, "block_threshold": a.point.block,
        "review_threshold": a.point.review, "fp_cost": metrics.FP_COST, "model_version": a.point.version,
        "expected_precision_at_block": a.report["cost_optimal"]["precision"],
        "expected_recall_at_block": a.report["cost_optimal"]["recall"]})


def load_point(spark, path: str) -> tuple[OperatingPoint, dict[str, float]]:
    """The saved operating point; without one, a 0.5 threshold and no calibration."""
    from riskloom.sources.readers import read_artefact
    from pyspark.sql.types import _parse_datatype_string

    cfg = sinks.read_document(spark, f"{path}/serving_config")
    knots = sorted((r["x"], r["y"]) for r in read_artefact(
        spark, f"{path}/calibrator", _parse_datatype_string("x double, y double")))
    point = OperatingPoint(
        block=cfg.get("block_threshold", 0.5), review=cfg.get("review_threshold", 0.25),
        model=cfg.get("shipped_model", "gbt"), version=cfg.get("model_version", MODEL_VERSION),
        calibrator="isotonic" if len(knots) >= 2 else "none",
        knots_x=tuple(x for x, _ in knots), knots_y=tuple(y for _, y in knots),
        explainer=cfg.get("shipped_model", "none"))
    return point, cfg.get("ensemble_weights", {})
