"""Scoring and review as streams over a file source."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskloom.plans.scoring import Service, log_rows, score
from riskloom.sources.sinks import stream_id, write_batch


def score_stream(requests: DataFrame, service: Service, audit: str, queue: str, checkpoint: str,
                 explained: bool = True, rejects: str | None = None, once: bool = False):
    """Start scoring a stream of requests; each micro-batch appends to the audit log and the queue.

    Parsed requests may still hold rejected ones (``reject_reason``): these go to the log at ``rejects``.
    Scoring keeps no state, so no watermark is needed. A batch that is replayed after a failure
    overwrites its own directory, which makes all logs exactly-once. The audit rows of a batch carry the time it took to score.

    With ``once`` a request id is scored once however often it is delivered (:func:`first_of_each`).
    """
    if once:
        requests = first_of_each(requests)
    checked = "reject_reason" in requests.columns
    if checked and not rejects:
        raise ValueError("rejected requests need a log to go to")

    def append(batch: DataFrame, number: int) -> None:
        stream = stream_id(batch.sparkSession, checkpoint)
        if checked:
            write_batch(batch.where("reject_reason IS NOT NULL").select("body", "reject_reason"), rejects, stream, number)
            batch = batch.where("reject_reason IS NULL").drop("body", "reject_reason")
        start = time.monotonic()
        scored = score(batch, service, explained, f"{stream}-{number}").persist()  # two sinks read it
        scored.count()
        rows, cases = log_rows(scored, service, round((time.monotonic() - start) * 1000, 3))
        write_batch(rows, audit, stream, number)
        write_batch(cases, queue, stream, number)
        scored.unpersist()

    return (requests.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def first_of_each(requests: DataFrame) -> DataFrame:
    """Drop requests whose id the stream has seen, in an earlier batch or in the same one.

    Ids are kept in keyed state, spread over the shuffle partitions, for the life of the checkpoint: a watermark would bound the state
    but let late repeats through. A large service sets ``spark.sql.streaming.stateStore.providerClass`` to RocksDB. Requests without an id, and rejected ones, are
    each of their own and pass.
    """
    if "request_id" not in requests.columns:
        return requests
    named = F.col("request_id").isNotNull()
    if "reject_reason" in requests.columns:
        named &= F.col("reject_reason").isNull()
    return requests.where(named).dropDuplicates(["request_id"]).unionByName(requests.where(~named))


STATE = "ts string, resolved boolean, status string, risk_score double"


def _fold(key: tuple, batches, state: GroupState):
    """The latest event of one case, a resolution after a queueing of the same time: in whatever order they arrive."""
    best = tuple(state.get) if state.exists else None
    for rows in batches:
        for r in rows.itertuples():
            if r.event not in ("queued", "resolved"):
                continue
            now = (r.ts or "", r.event == "resolved")
            status = r.action if now[1] else "pending"
            risk = None if pd.isna(r.risk_score) else float(r.risk_score)
            if best is None or now > (best[0], best[1]):
                best = (*now, status, risk)
    if best is None:
        return
    state.update(best)
    yield pd.DataFrame({"request_id": [key[0]], "status": [best[2]], "risk_score": [best[3]], "ts": [best[0]]})


def review_stream(events: DataFrame) -> DataFrame:
    """Status changes of review cases, with cases held in the state store by request_id.

    The status is that of ``review.state`` over the same events, whatever their order and however late. So there is no
    watermark, which would drop rows, and a closed case stays as a marker of its last event: one row of four values a case.
    """
    rows = events.select("request_id", "event", "ts", "risk_score", "action")
    return rows.groupBy("request_id").applyInPandasWithState(
        _fold, "request_id string, status string, risk_score double, ts string", STATE, "update", GroupStateTimeout.NoTimeout)


def latest_status(changes: DataFrame) -> DataFrame:
    """The current status of each case from the stream of its changes."""
    body = F.struct("ts", "status", "risk_score")
    # A change can repeat its time stamp; the version written last carries the settled status.
    order = F.struct("batch")
    return changes.groupBy("request_id").agg(F.max_by(body, order).alias("_s")).select("request_id", "_s.*")
