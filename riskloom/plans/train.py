"""Fit every family, keep its scores, and find the blend; a rerun continues where the last one stopped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators import blending, context, metrics, requests, splits
from riskloom.operators.lookup import interpolate
from riskloom.plans import modelling, tuning
from riskloom.plans.modelling import FAMILIES, Fitted
from riskloom.schema import LABEL
from riskloom.sources import readers, sinks
from riskloom.sources.shared import materialize

PREDICTION = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("split", T.StringType()), T.StructField(LABEL, T.IntegerType()),
    T.StructField("abs_amount", T.DoubleType()), T.StructField("score", T.DoubleType()),
])


def read_predictions(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Stored validation scores of one model; empty when it has none."""
    return readers.read_or_empty(spark, f"{path}/model={model}", PREDICTION)


def aligned(spark: SparkSession, path: str, models: Sequence[str]) -> DataFrame:
    """Scores of several models side by side, matched by id (never by position)."""
    out = None
    for m in models:
        one = read_predictions(spark, path, m).withColumnRenamed("score", m)
        out = one if out is None else out.join(one.select("id", m), "id")
    return out


def shipped_half_life(infos: dict[str, dict], shipped: str) -> int:
    """The recency half-life of the served model; for a blend, of the first member that has one."""
    names = list(infos) if shipped == "ensemble" else [shipped]
    return next((int(h) for n in names if (h := infos.get(n, {}).get("recency_half_life_days"))), 0)


def run(spark: SparkSession, table: str, out: str, families: Sequence[str] = FAMILIES,
        params: dict[str, dict] | None = None, force: bool = False) -> tuple[dict[str, Fitted], dict[str, float]]:
    """Train on the split table at ``table``; models, scores and the summary go below ``out``.

    Parameters come from ``params``, else from the best stored trial, else from the defaults.
    """
    rows = materialize(splits.val_cut(readers.read_split(spark, table)))
    part = lambda *names: rows.where(F.col("split").isin(*names))
    train, val = part("train"), part("val_fit", "val_sel")
    levels = requests.levels_dict(context.learn_levels(train))
    n_val = val.count()
    members, summary = {}, []
    for name in families:
        stored = {} if force else modelling.load(spark, f"{out}/models", [name])
        if stored and read_predictions(spark, f"{out}/val_scores", name).count() == n_val:
            members[name] = stored[name]
            summary.append({"model": name, "restored": True, **stored[name].info})
            continue
        tuned = tuning.best(readers.read_or_empty(spark, f"{out}/trials", tuning.TRIAL).where(F.col("family") == name))
        chosen, half_life = (params[name], 0) if params and name in params else (tuned or ({}, 0))
        fitted = modelling.fit(name, train, part("val_fit"), levels, chosen, half_life)
        modelling.save(fitted, f"{out}/models")
        scored = modelling.predict(fitted, val, "score").select(*[F.col(f.name).cast(f.dataType) for f in PREDICTION.fields])
        sinks.write_predictions(scored, f"{out}/val_scores", name)
        members[name] = fitted
        summary.append({"model": name, "restored": False, **fitted.info})

    names = list(members)
    wide = materialize(aligned(spark, f"{out}/val_scores", names))
    weights = blending.best_blend(wide.where("split = 'val_fit'"), names)
    used = {m: F.col(m) for m in names if weights.get(m, 0) > 0}
    wide = wide.withColumn("ensemble", blending.blend(used, weights))
    quality = {r["model"]: r.asDict() for r in blending.val_quality(wide, [*names, "ensemble"]).collect()}
    fit_rows, sel = (wide.where(F.col("split") == s) for s in ("val_fit", "val_sel"))
    xs, ys = blending.fit_isotonic(fit_rows, "ensemble")
    error = lambda df, c: metrics.calibration_error(df, c).first()[0]
    single = max(quality[m]["average_precision"] for m in names)
    sinks.write_document(spark, f"{out}/training_summary", {
        "models": [{**s, "val_average_precision": quality[s["model"]]["average_precision"],
                    "val_roc_auc": quality[s["model"]]["roc_auc"]} for s in summary],
        "ensemble_weights": weights, "ensemble": quality["ensemble"],
        "beats_best_single_on_val": quality["ensemble"]["average_precision"] > single,
        "calibration": {"method": "isotonic", "ece_before": error(sel, "ensemble"),
                        "ece_after": error(interpolate(sel, xs, ys, "ensemble", "cal"), "cal")},
        "val_fit_fraction": splits.VAL_FIT_FRACTION, "val_rows": n_val})
    sinks.write_document(spark, f"{out}/levels", levels)
    return members, weights
