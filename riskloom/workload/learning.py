"""Queries: sources and sinks, model fitting, attribution, tuning, assessment, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import parsing
from riskloom.operators import context, decisions, requests, review, splits
from riskloom.operators.decisions import OperatingPoint
from riskloom.operators.skew import left_lookup
from riskloom.plans import assess, attribution, modelling, review_log, scoring, train, tuning
from riskloom.schema import FEATURES, REQUEST, REVIEW_EVENT
from riskloom.sources import readers, sinks
from riskloom.sources.shared import materialize, release, scratch, spread
from riskloom.streaming import scoring as streams
from riskloom.workload.deciding import POINT, _BAND, _RULE, _REVIEW, _log, frame
from riskloom.workload.tables import ENRICHED, TXN, enriched, read, split_sql, transactions

Q: dict = {}


def query(sql: str | None = None):
    def keep(fn):
        Q[fn.__name__] = (fn, sql)
        return fn
    return keep


# ----------------------------------------------------------------------- sources and sinks


@query(f"WITH {TXN} SELECT id, is_fraud FROM t")
def label_map_scan(spark, sf):
    """Labels written as one JSON map and read back in parallel pieces."""
    path = scratch(spark, "labels")
    t = transactions(spark, sf)
    entry = F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('": "'),
                     F.when(F.col("is_fraud") == 1, "Yes").otherwise("No"), F.lit('",'))
    t.select(entry.alias("value")).write.text(path)
    return readers.read_labels(spark, path)


@query(f"""WITH {TXN} SELECT id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, CAST(card_id AS INTEGER) AS card_id, amount, use_chip, zip, errors, is_fraud
  FROM t WHERE id % 4 <> 0""")
def csv_scan(spark, sf):
    """Transactions as a CSV file: typed scan, kept only where labelled."""
    path = scratch(spark, "transactions")
    t = transactions(spark, sf)
    t.select("id", F.date_format("date", parsing.DATE_FORMAT).alias("date"), F.col("client_id").cast("int").alias("client_id"),
             F.col("card_id").cast("int").alias("card_id"), F.concat(F.lit("$"), F.format_number("amount", 2)).alias("amount"),
             "use_chip", F.lit(None).cast("string").alias("merchant_state"), "zip", F.col("k").alias("mcc"), "errors",
             ).write.option("header", True).csv(path)
    labels = t.where(F.col("id") % 4 != 0).select("id", "is_fraud")
    rows = readers.read_transactions(spark, path, labels)
    return rows.select("id", "date", "card_id", parsing.money(F.col("amount")).alias("amount"), "use_chip", "zip", "errors", "is_fraud")


@query(f"""WITH {TXN}, {split_sql()} SELECT id, round(abs_amount, 6) AS abs_amount FROM s WHERE split = 'test'""")
def split_table_scan(spark, sf):
    """The split table on disk: partition pruning on the split, column pruning on the projection."""
    path = scratch(spark, "splits")
    f = splits.time_split(frame(spark, sf), source=transactions(spark, sf))
    sinks.write_splits(f, path)
    return readers.read_split(spark, path, "test", ["id", "abs_amount"]).withColumn("abs_amount", F.round("abs_amount", 6))


@query(f"""WITH {_REVIEW} SELECT CAST(id AS VARCHAR) AS request_id, 'queued' AS event, round(score, 6) AS risk_score FROM cases
  UNION ALL SELECT request_id, 'resolved', risk_score FROM done""")
def review_log_scan(spark, sf):
    """The review log as JSON Lines, with broken lines in between that a reader must skip."""
    path = scratch(spark, "review")
    log, _, _ = _log(spark, sf)
    sinks.append_log(log.select("event", "request_id", "ts", "risk_score", "amount", "action"), path)
    log.select(F.concat(F.lit('{"event": "queued", "request_id'), "request_id").alias("value")).write.mode("append").text(path)
    return readers.read_log(spark, path).where(F.col("event").isNotNull()).select("request_id", "event", "risk_score")


@query(f"""WITH {TXN} SELECT id, score AS a, score_b AS b FROM t""")
def predictions_scan(spark, sf):
    """Scores stored per model, read back by model and matched by id."""
    path = scratch(spark, "predictions")
    t = transactions(spark, sf).withColumn("split", F.lit("val_fit"))
    for model, c in (("a", "score"), ("b", "score_b")):
        sinks.write_predictions(t.select("id", "split", "is_fraud", "abs_amount", F.col(c).alias("score")), path, model)
    return train.aligned(spark, path, ["a", "b"]).select("id", "a", "b")


@query("SELECT n_nationkey AS mcc, n_name AS name, count(*) AS customers FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2")
def code_list_scan(spark, sf):
    """A JSON code list written and read back, then looked up by every customer."""
    path = scratch(spark, "codes")
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.col("n_name"))))
    read(spark, sf, "nation").agg(F.to_json(pairs).alias("value")).write.text(path)
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("mcc"))
    return left_lookup(c, readers.read_codes(spark, path), "mcc").groupBy("mcc", "name").agg(F.count(F.lit(1)).alias("customers"))


# ----------------------------------------------------------------------------- modelling


_kept: dict = {}


def _once(spark, key, make):
    """Queries of one session share the prepared rows and the fitted models."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def _modelling_rows(spark, sf):
    def make():
        f = splits.time_split(frame(spark, sf), source=transactions(spark, sf))
        table = materialize(f.select("id", "date", "split", *FEATURES, "is_fraud"))
        even = spread(table, table.count())
        if even.rdd.getNumPartitions() > table.rdd.getNumPartitions():  # fewer files than cores: every fit and score would wait for them
            even = materialize(even)
            release(spark, [table.table_path])
            table = even
        rows = splits.val_cut(table)
        levels = requests.levels_dict(context.learn_levels(rows.where("split = 'train'")))
        return rows, levels
    return _once(spark, ("rows", sf), make)


def _part(rows, name):
    return rows.where(F.col("split") == name)


def _fit(spark, sf, name, half_life=10.0):
    rows, levels = _modelling_rows(spark, sf)
    return _once(spark, ("model", sf, name), lambda: modelling.fit(
        name, _part(rows, "train"), _part(rows, "val_fit"), levels, half_life=half_life))


@query()
def model_scores(spark, sf):
    """Three families fitted on train, scored on every later row, as one long table."""
    rows, levels = _modelling_rows(spark, sf)
    later = rows.where("split <> 'train'")
    for name in modelling.FAMILIES:
        later = modelling.predict(_fit(spark, sf, name), later, name)
    return later.select("id", "split", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in modelling.FAMILIES])))


@query()
def tree_attribution(spark, sf):
    """Shapley contributions of the boosted model for each row."""
    rows, levels = _modelling_rows(spark, sf)
    out = attribution.with_contributions(_fit(spark, sf, "gbt"), rows.select("id", *FEATURES))
    return out.select("id", *[c for c in out.columns if c.startswith("_contrib_")])


@query()
def linear_attribution(spark, sf):
    rows, levels = _modelling_rows(spark, sf)
    out = attribution.with_contributions(_fit(spark, sf, "linear"), rows.select("id", *FEATURES),
                                         _part(rows, "train"))
    return out.select("id", *[c for c in out.columns if c.startswith("_contrib_")])


@query()
def top_factors(spark, sf):
    """The six strongest factors of each row with their evidence."""
    rows, levels = _modelling_rows(spark, sf)
    history = _part(rows, "train")
    out = attribution.with_contributions(_fit(spark, sf, "gbt"), rows.select("id", *FEATURES))
    ranked = decisions.top_factors(out, context.build(history, 10.0))
    # Every row has factors. A plain ``inline`` would have Spark infer a filter on the array and evaluate all of it once more.
    return ranked.select("id", F.inline_outer("top_factors"))


@query()
def tuned_search(spark, sf):
    """All trials of the seeded search for each family, scored on val_fit; a trial that failed is an error when its value is read."""
    rows, levels = _modelling_rows(spark, sf)
    path = scratch(spark, "trials")
    for family in modelling.FAMILIES:
        tuning.tune(spark, family, _part(rows, "train"), _part(rows, "val_fit"), levels, path, trials=tuning.TRIALS, frac=1.0)
    return tuning.valued(tuning.settled(readers.read_or_empty(spark, path, tuning.TRIAL))).select("family", "number", "params", "half_life", "value")


def _assessed(spark, sf):
    return _once(spark, ("assessed", sf), lambda: _assess(spark, sf))


def _assess(spark, sf):
    rows, levels = _modelling_rows(spark, sf)
    members = {n: _fit(spark, sf, n) for n in modelling.FAMILIES}
    predictions = assess.predict_all(members, rows.where("split <> 'train'"))
    return rows, levels, members, assess.run(predictions, list(members))


@query()
def assessment(spark, sf):
    """The whole protocol: leaderboard on test with the shipped and the best-on-validation flags."""
    _, _, _, a = _assessed(spark, sf)
    return a.board


@query()
def score_requests(spark, sf):
    """Requests rebuilt from all rows, scored end to end and explained."""
    rows, levels, members, a = _assessed(spark, sf)
    ctx = context.build(_part(rows, "train"), 10.0, a.scored_val)
    service = scoring.Service(requests.Dictionaries(None, None, 60.0, levels), a.point, members, a.weights, ctx)
    service.point.explainer = "gbt"
    asked = requests.to_request(rows).withColumn("request_id", F.col("id").cast("string"))
    return scoring.score(asked, service).select(
        "request_id", "risk_score", "risk_percent", "decision", "rule_id", "missing_fields", "top_factors", "base_rate")


# ------------------------------------------------------------------------------- streams


def _formula_service():
    score = F.col("abs_amount") / (F.col("abs_amount") + 100)
    return scoring.Service(requests.Dictionaries(), POINT, formula=score)


def _event_stream(spark, sf):
    schema = read(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query(f"""WITH {TXN}, d AS (SELECT *, {_BAND} AS dec FROM t)
  SELECT CAST(id AS VARCHAR) AS request_id, amount, round(score, 6) AS risk_score, dec AS decision, {_RULE.format(d='dec')} AS rule_id FROM d""")
def stream_score(spark, sf):
    """Events as a stream of JSON requests through validation, features, decision and audit log."""
    base = scratch(spark, "stream")
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("request_id"), F.col("value").alias("amount"),
                              F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.col("event_type").alias("mcc_category")))
    parsed = requests.parse_json(_event_stream(spark, sf).select(body.alias("body")))
    streams.score_stream(parsed, _formula_service(), f"{base}/audit", f"{base}/queue", f"{base}/state", rejects=f"{base}/rejects").awaitTermination()
    return spark.read.json(f"{base}/audit").select("request_id", "amount", "risk_score", "decision", "rule_id")


@query("""SELECT CAST(event_id AS VARCHAR) AS request_id, CASE WHEN event_id % 7 = 0 THEN 'amount is required'
    WHEN event_id % 11 = 0 THEN 'amount has the wrong type' END AS reject_reason FROM events""")
def stream_rejects(spark, sf):
    """A stream with bad requests: what is scored and what is set apart together are all of them."""
    base = scratch(spark, "rejects")
    amount = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, F.lit("much")).otherwise(F.col("value").cast("string"))
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("request_id"), amount.alias("amount"), F.col("event_type").alias("mcc_category")))
    parsed = requests.parse_json(_event_stream(spark, sf).select(body.alias("body")))
    streams.score_stream(parsed, _formula_service(), f"{base}/audit", f"{base}/queue", f"{base}/state", rejects=f"{base}/rejects").awaitTermination()
    bad = spark.read.json(f"{base}/rejects").select(F.get_json_object("body", "$.request_id").alias("request_id"), "reject_reason")
    return spark.read.json(f"{base}/audit").select("request_id", F.lit(None).cast("string").alias("reject_reason")).unionByName(bad)


@query("SELECT CAST(event_id AS VARCHAR) AS request_id, CAST(2 AS BIGINT) AS times FROM events")
def stream_restart(spark, sf):
    """A second stream with a checkpoint of its own adds to the log and leaves what the first one wrote."""
    base = scratch(spark, "restart")
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("request_id"), F.col("value").alias("amount")))
    parsed = requests.parse_json(_event_stream(spark, sf).select(body.alias("body")))
    for run in ("one", "two"):
        streams.score_stream(parsed, _formula_service(), f"{base}/audit", f"{base}/queue", f"{base}/{run}", rejects=f"{base}/rejects").awaitTermination()
    return spark.read.json(f"{base}/audit").groupBy("request_id").agg(F.count(F.lit(1)).alias("times"))


@query("SELECT CAST(event_id AS VARCHAR) AS request_id, CAST(1 AS BIGINT) AS times, TRUE AS timed FROM events")
def stream_once(spark, sf):
    """Every file of requests is delivered twice, and one of the deliveries repeats rows: each request is scored and logged once."""
    base = scratch(spark, "once")
    asked = read(spark, sf, "events").select(F.col("event_id").cast("string").alias("request_id"), F.col("value").alias("amount"))
    for more in (asked, asked.unionByName(asked)):
        more.write.mode("append").json(f"{base}/in")
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 2).json(f"{base}/in")
    streams.score_stream(stream, _formula_service(), f"{base}/audit", f"{base}/queue", f"{base}/state", once=True).awaitTermination()
    return spark.read.json(f"{base}/audit").groupBy("request_id").agg(F.count(F.lit(1)).alias("times"), F.min(F.col("latency_ms") > 0).alias("timed"))


_STATUS = f"""WITH {_REVIEW} SELECT CAST(id AS VARCHAR) AS request_id, 'pending' AS status, round(score, 6) AS risk_score FROM pend
  UNION ALL SELECT request_id, action, risk_score FROM done"""


@query(_STATUS)
def stream_review_shuffled(spark, sf):
    """Review events that arrive in any order end in the status that the whole log gives."""
    base = scratch(spark, "review-shuffled")
    log, _, _ = _log(spark, sf)
    log = materialize(log.select("event", "request_id", "ts", "risk_score", "action"))
    late = F.pmod(F.xxhash64("request_id", "event"), F.lit(3))
    for part in range(3):
        log.where(late == part).coalesce(1).write.mode("append").json(f"{base}/events")
    events = spark.readStream.schema(REVIEW_EVENT).option("maxFilesPerTrigger", 1).json(f"{base}/events")

    def append(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/changes/b={number}")

    (streams.review_stream(events).writeStream.outputMode("update").foreachBatch(append)
     .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination())
    return streams.latest_status(spark.read.parquet(f"{base}/changes")).select("request_id", "status", "risk_score")


@query(f"""WITH {_REVIEW} SELECT CAST(id AS VARCHAR) AS request_id, 'pending' AS status, round(score, 6) AS risk_score FROM pend
  UNION ALL SELECT request_id, action, risk_score FROM done""")
def stream_review(spark, sf):
    """Review events streamed into keyed state: the status every case ends in."""
    base = scratch(spark, "review-stream")
    log, _, _ = _log(spark, sf)
    log.select("event", "request_id", "ts", "risk_score", "action").write.json(f"{base}/events")
    events = spark.readStream.schema(REVIEW_EVENT).json(f"{base}/events")

    def append(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/changes/b={number}")

    (streams.review_stream(events).writeStream.outputMode("update").foreachBatch(append)
     .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination())
    return streams.latest_status(spark.read.parquet(f"{base}/changes")).select("request_id", "status", "risk_score")


def _snapshots(spark, sf):
    """The review log in five batches of two streams: a snapshot after two of them, another after four."""
    base = scratch(spark, "review-log")
    log, _, _ = _log(spark, sf)
    log = materialize(log.select(*[c for c in log.columns if c in REVIEW_EVENT.names]))
    kept = review_log.ReviewLog(spark, f"{base}/log", f"{base}/store")
    part = F.pmod(F.xxhash64("request_id", "event"), F.lit(5))
    for k in range(5):
        kept.append(log.where(part == k), "ab"[k % 2], k // 2)
        if k in (1, 3):
            kept.compact()
    return kept


@query(f"WITH {_REVIEW} SELECT CAST(id AS VARCHAR) AS request_id, round(score, 6) AS risk_score, 'score in review band' AS queued_reason FROM pend")
def snapshot_pending(spark, sf):
    """Pending cases from the last snapshot and the batches after it."""
    return _snapshots(spark, sf).pending().select("request_id", "risk_score", "queued_reason")


@query(f"""WITH {_REVIEW} SELECT (SELECT count(*) FROM done) AS resolved, (SELECT count(*) FROM done WHERE action = 'approve') AS approved,
  (SELECT count(*) FROM done WHERE action = 'decline') AS declined, (SELECT count(*) FROM pend) AS pending""")
def snapshot_stats(spark, sf):
    return _snapshots(spark, sf).stats()


@query(f"""WITH {_REVIEW} SELECT 'ok' AS status, 'frm-1.0.0' AS model_version, 'stand-in' AS scored_by, CAST(0.45 AS DOUBLE) AS review_threshold,
  CAST(0.56 AS DOUBLE) AS block_threshold, 'none' AS calibrator, (SELECT count(*) FROM pend) AS pending, (SELECT count(*) FROM done) AS resolved,
  (SELECT count(*) FROM t WHERE is_fraud = 0) AS reference_rows, (SELECT round(avg(is_fraud), 9) FROM t) AS overall_fraud_rate""")
def service_health(spark, sf):
    t = transactions(spark, sf)
    log, _, _ = _log(spark, sf)
    service = _formula_service()
    service.context = context.Context(overall=t.agg(F.avg("is_fraud")).first()[0], reference_rows=t.where("is_fraud = 0").count())
    return scoring.health(spark, service, log).select(
        "status", "model_version", "scored_by", "review_threshold", "block_threshold", "calibrator", "pending", "resolved",
        "reference_rows", F.round("overall_fraud_rate", 9).alias("overall_fraud_rate"))
