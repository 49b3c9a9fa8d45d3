"""End-to-end scoring of requests: features, score, calibration, decision, explanation, log rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.hashing import fingerprint
from riskloom.operators import decisions, review
from riskloom.operators.blending import blend
from riskloom.operators.context import Context
from riskloom.operators.decisions import OperatingPoint
from riskloom.operators.requests import Dictionaries, as_requests, featurize
from riskloom.plans.attribution import with_contributions
from riskloom.plans.modelling import Fitted, predict


@dataclass
class Service:
    """Everything fitted that scoring needs. All of it is small; nothing is read per row."""

    dictionaries: Dictionaries
    point: OperatingPoint
    members: dict[str, Fitted] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    context: Context = field(default_factory=Context)
    # A Column stands in for the model where none is fitted.
    formula: object = None


def load_service(spark, path: str, codes: str | None = None) -> Service:
    """Assemble a service from what the other plans saved below ``path``.

    Only the members the served model needs are loaded. Whatever is absent is left at its
    default, so a partly built folder still scores.
    """
    from pyspark.sql.types import StructType

    from riskloom.operators import context
    from riskloom.plans import assess, modelling
    from riskloom.sources import readers, sinks

    point, weights = assess.load_point(spark, path)
    needed = [n for n in modelling.FAMILIES if weights.get(n, 0) > 0] if point.model == "ensemble" else [point.model]
    members = modelling.load(spark, f"{path}/models", needed)
    if point.explainer not in members:
        point.explainer = next(iter(members), "none")
    overall = readers.read_or_empty(spark, f"{path}/global_median", StructType.fromDDL("med double")).first()
    medians = readers.read_or_empty(spark, f"{path}/category_medians", StructType.fromDDL("mcc_category string, med double"))
    names = readers.read_codes(spark, codes) if codes else None
    dictionaries = Dictionaries(names, medians, overall["med"] if overall else 0.0, sinks.read_document(spark, f"{path}/levels"))
    return Service(dictionaries, point, members, weights, context.load(spark, f"{path}/context"))


def raw_score(df: DataFrame, service: Service) -> DataFrame:
    """The served model's probability, or the blend of the members at hand."""
    if not service.members:
        return df.withColumn("raw_score", service.formula)
    shipped = service.point.model
    wanted = service.members if shipped == "ensemble" else {
        k: v for k, v in service.members.items() if k == shipped} or dict([next(iter(service.members.items()))])
    out = df
    for name, fitted in wanted.items():
        out = predict(fitted, out, f"_score_{name}")
    cols = {n: F.col(f"_score_{n}") for n in wanted}
    score = blend(cols, service.weights) if len(cols) > 1 else next(iter(cols.values()))
    return out.withColumn("raw_score", score).drop(*[f"_score_{n}" for n in wanted])


def with_ids(kept: DataFrame, origin: str) -> DataFrame:
    """Give requests without an id one of their own: fingerprint, origin, and a number among equal requests.

    Equal rows are counted, map-side first, and dealt out again with numbers, so a retried batch repeats the ids
    and twins stay two requests.
    """
    nameless = kept.where("request_id IS NULL")
    if nameless.isEmpty():
        return kept
    apart = nameless.groupBy(*kept.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    made = F.concat_ws("-", "input_sha256", F.lit(origin or None), F.col("_k").cast("string"))
    return kept.where("request_id IS NOT NULL").unionByName(apart.withColumn("request_id", made).select(*kept.columns))


def score(requests: DataFrame, service: Service, explained: bool = True, origin: str = "") -> DataFrame:
    """Requests to decisions. Works on batches and inside a stream's micro-batches.

    ``request_id`` comes from the caller so that a retried task logs the same id; without one, the fingerprint
    of the request, ``origin`` (which batch it came in) and a number stand in.
    """
    typed = as_requests(requests)
    kept = typed.withColumns({"input_sha256": fingerprint(typed), "request_category": F.col("mcc_category")})
    kept = with_ids(kept, origin)
    rows = raw_score(featurize(kept, service.dictionaries), service)
    explainer = service.members.get(service.point.explainer)
    if explained and explainer is not None:
        rows = with_contributions(explainer, rows)
    return decisions.explain(decisions.decide(rows, service.point), service.context)


def log_rows(scored: DataFrame, service: Service, latency_ms: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(audit rows, queued review cases) of scored requests."""
    return decisions.audit_rows(scored, service.point, latency_ms=latency_ms), decisions.review_cases(scored, service.point)


def respond(requests: DataFrame, service: Service, explained: bool = True, origin: str = "", latency_ms: float | None = None) -> DataFrame:
    """Requests to full responses: decision, thresholds, factors, who scored and who explained."""
    return decisions.responses(score(requests, service, explained, origin), service.point, latency_ms)


def health(spark, service: Service, review_events: DataFrame) -> DataFrame:
    """One row: operating point, calibrator, review counts, size of the reference."""
    p, c = service.point, service.context
    return review.stats(review_events).select(
        F.lit("ok").alias("status"), F.lit(p.version).alias("model_version"), F.lit(p.model).alias("scored_by"),
        F.lit(p.explainer).alias("explained_by"), F.lit(p.review).alias("review_threshold"),
        F.lit(p.block).alias("block_threshold"), F.lit(p.calibrator).alias("calibrator"),
        "pending", "resolved", "approved", "declined",
        F.lit(c.available).alias("context_available"), F.lit(c.reference_rows).cast("bigint").alias("reference_rows"),
        F.lit(float(c.overall)).alias("overall_fraud_rate"))
