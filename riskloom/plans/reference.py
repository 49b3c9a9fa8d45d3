"""The context stage: what evidence compares with, built from stored scores and the serving configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import blending, context, decisions
from riskloom.plans import assess, train
from riskloom.schema import LABEL
from riskloom.sources import readers, sinks


def shipped_scores(spark: SparkSession, out: str) -> DataFrame:
    """Stored validation scores of the served model, blended and calibrated as it serves them."""
    point, weights = assess.load_point(spark, out)
    names = [n for n, w in weights.items() if w > 0] if point.model == "ensemble" else [point.model]
    wide = train.aligned(spark, f"{out}/val_scores", names)
    raw = blending.blend({n: F.col(n) for n in names}, weights) if len(names) > 1 else F.col(names[0])
    scored = decisions.calibrate(wide.withColumn("raw_score", raw), point, "raw_score", "score")
    return scored.select("id", "split", LABEL, "abs_amount", "raw_score", "score")


def run(spark: SparkSession, table: str, out: str) -> context.Context:
    """Percentiles, base rates weighted by the half-life of the served model, and score bands, saved below ``out``."""
    point, _ = assess.load_point(spark, out)
    infos = {m["model"]: m for m in sinks.read_document(spark, f"{out}/training_summary").get("models", [])}
    half_life = train.shipped_half_life(infos, point.model)
    built = context.build(readers.read_split(spark, table, "train"), half_life or None, shipped_scores(spark, out))
    context.save(built, spark, f"{out}/context")
    return built
