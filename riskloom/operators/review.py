"""The human-review queue as an append-only event log; its state is always derived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.decisions import MODEL_VERSION, RULES
from riskloom.sources.shared import materialize, scope
from riskloom.sources.sinks import append_log

ACTIONS = ("approve", "decline")
MAX_REVIEWER, MAX_NOTE = 64, 500
DEFAULT_REVIEWER = "demo-reviewer"


def _renamed_reason(c):
    return F.when(c == "gate downgrade", "legacy gate review").otherwise(c)


def state(events: DataFrame) -> DataFrame:
    """The latest event of every case: one row per request_id.

    Folding is a map-side combined maximum on (ts, resolved-after-queued), so neither one busy
    case nor the log's order on disk matters.
    """
    known = events.where(F.col("event").isin("queued", "resolved"))
    body = F.struct(*[F.col(c) for c in events.columns if c != "request_id"])
    order = F.struct(F.col("ts"), (F.col("event") == "resolved").cast("int"))
    latest = known.groupBy("request_id").agg(F.max_by(body, order).alias("_e"))
    return latest.select("request_id", "_e.*")


def pending(events: DataFrame) -> DataFrame:
    """Cases queued and not resolved since."""
    return state(events).where(F.col("event") == "queued").withColumn(
        "queued_reason", _renamed_reason(F.col("queued_reason")))


def list_pending(events: DataFrame, n: int = 100) -> DataFrame:
    """The n riskiest pending cases; a case without a score counts as 0."""
    return pending(events).orderBy(F.desc(F.coalesce("risk_score", F.lit(0.0))), "request_id").limit(max(n, 1))


def count_columns() -> list:
    done = F.col("event") == "resolved"
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).cast("bigint")
    return [count(done).alias("resolved"), count(done & (F.col("action") == "approve")).alias("approved"), count(done & (F.col("action") == "decline")).alias("declined")]


def counts(events: DataFrame) -> DataFrame:
    """One row: how many resolutions there are, and of each kind."""
    return events.agg(*count_columns())


def stats(events: DataFrame) -> DataFrame:
    open_cases = pending(events).agg(F.count(F.lit(1)).alias("pending")).scalar()
    return counts(events).withColumn("pending", open_cases)


def check_resolutions(resolutions: DataFrame) -> DataFrame:
    """Add ``problem``: NULL for a well-formed resolution."""
    filled = resolutions.withColumns({
        "reviewer": F.coalesce("reviewer", F.lit(DEFAULT_REVIEWER)), "note": F.coalesce("note", F.lit(""))})
    return filled.withColumn(
        "problem",
        F.when(F.col("request_id").isNull(), "request_id is required")
        .when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "action must be approve or decline")
        .when(F.length("reviewer") > MAX_REVIEWER, "reviewer is too long")
        .when(F.length("note") > MAX_NOTE, "note is too long"))


def resolve(events: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Match resolutions (request_id, ts, action, reviewer, note) to pending cases.

    Returns (resolved events to append, rejected resolutions). Of the well-formed resolutions of a pending case the
    first is accepted; every other row is rejected with its reason, also one that repeats another. So
    replaying a batch changes nothing.
    """
    checked = check_resolutions(resolutions)
    said = ["ts", "action", "reviewer", "note"]
    body = F.struct(*said)
    # Rows that repeat each other are counted, map-side first, so many of them meet in no task.
    sound = checked.where(F.col("problem").isNull()).groupBy("request_id", *said).agg(F.count(F.lit(1)).alias("_n"))
    cases = pending(events).select("request_id", "risk_score", "queued_reason")
    first = sound.groupBy("request_id").agg(F.min(body).alias("_r")).join(cases, "request_id")
    accepted = first.select(F.lit("resolved").alias("event"), "request_id", "_r.*", "risk_score", "queued_reason")
    taken = first.select("request_id", F.col("_r").alias("_taken"))
    rest = F.col("_n") - F.coalesce((body == F.col("_taken")).cast("int"), F.lit(0))
    columns = ["request_id", *said, "problem"]
    others = (sound.join(taken, "request_id", "left").where(rest > 0).withColumn("_k", F.explode(F.sequence(F.lit(1), rest)))
              .withColumn("problem", F.lit("no pending review")))
    rejected = checked.where(F.col("problem").isNotNull()).select(*columns).unionByName(others.select(*columns))
    return accepted, rejected


def resolve_and_log(events: DataFrame, resolutions: DataFrame, queue: str, audit: str, rejects: str) -> None:
    """Append accepted resolutions to the queue's log with an audit row each, and the others to a log of their own."""
    with scope(events.sparkSession):
        accepted, rejected = (materialize(x) for x in resolve(events, resolutions))
        append_log(accepted, queue)
        append_log(resolution_audit(accepted), audit)
        append_log(rejected, rejects)


def resolution_audit(accepted: DataFrame, version: str = MODEL_VERSION) -> DataFrame:
    """The audit row that every accepted resolution leaves behind."""
    return accepted.select(
        "ts", "request_id", F.lit("human_review_resolved").alias("decision"),
        F.col("action").alias("review_action"), "reviewer", "note", "risk_score",
        F.lit(RULES["resolved"]).alias("rule_id"), F.lit(version).alias("model_version"))
