"""Queries: what jobs store, written by their sinks and read back: dimension files, fitted tables, reports, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import parsing
from riskloom.operators import context, medians, metrics, requests, review, splits
from riskloom.operators.blending import fit_isotonic
from riskloom.operators.decisions import OperatingPoint, review_cases
from riskloom.plans import assess, modelling
from riskloom.schema import check_roles
from riskloom.sources import readers, sinks
from riskloom.sources.shared import scratch
from riskloom.workload import deciding, measuring, preparing
from riskloom.workload.deciding import FRAME, POINT, _REVIEW, frame
from riskloom.workload.tables import CARD, TXN, USER, cards, enriched, split_sql, transactions, users

Q: dict = {}


def query(sql: str | None = None):
    def keep(fn):
        Q[fn.__name__] = (fn, sql)
        return fn
    return keep


# ----------------------------------------------------------------------------- scans


@query(f"""WITH {CARD} SELECT card_id, card_brand, card_type, has_chip, credit_limit, strftime(opened, '%m/%Y') AS acct_open_date,
  CAST(pin_year AS VARCHAR) AS year_pin_last_changed, card_on_dark_web FROM c""")
def cards_scan(spark, sf):
    """The card file: its id becomes the key, columns that are never used are not read."""
    path = scratch(spark, "cards")
    c = cards(spark, sf).withColumnRenamed("card_id", "id")
    c.withColumns({"card_number": F.lit("4000"), "num_cards_issued": F.lit(1), "cvv": F.lit("000")}).write.option("header", True).csv(path)
    flags = {f: parsing.yes_flag(F.col(f)) for f in ("has_chip", "card_on_dark_web")}
    return readers.read_cards(spark, path).withColumns({**flags, "credit_limit": parsing.money(F.col("credit_limit"))}).drop("num_cards_issued")


@query(f"""WITH {USER} SELECT client_id, CAST(18 + client_id % 70 AS VARCHAR) AS current_age, CASE WHEN client_id % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
  yearly_income, total_debt, CAST(300 + client_id % 550 AS VARCHAR) AS credit_score FROM u""")
def users_scan(spark, sf):
    """The cardholder file, without names and addresses."""
    path = scratch(spark, "users")
    u = users(spark, sf).withColumnRenamed("client_id", "id")
    u.withColumns({"address": F.col("home_state"), "current_age": 18 + F.col("id") % 70, "gender": F.when(F.col("id") % 2 == 0, "Female").otherwise("Male"),
                   "per_capita_income": F.lit("$1"), "credit_score": 300 + F.col("id") % 550, "num_credit_cards": F.lit(1)}).write.option("header", True).csv(path)
    money = {c: parsing.money(F.col(c)) for c in ("yearly_income", "total_debt")}
    return readers.read_users(spark, path).withColumns(money).drop("per_capita_income", "num_credit_cards")


def _known(c: str, also: str = "") -> str:
    return f"CASE WHEN {c} IN (SELECT {c} FROM s WHERE split = 'train' AND {c} IS NOT NULL{also}) THEN {c} END AS {c}"


@query(f"""WITH {FRAME}, {split_sql('f')} SELECT id, is_fraud, round(abs_amount, 6) AS abs_amount, hour, {_known('mcc_category', " AND mcc_category <> 'signup'")},
  {_known('card_brand')}, {_known('error_kind')} FROM s WHERE split = 'test'""")
def feature_scan(spark, sf):
    """Features and label of the test period from the split table; levels that training did not hold (here one is withheld) are missing."""
    path = scratch(spark, "splits")
    sinks.write_splits(splits.time_split(frame(spark, sf), source=transactions(spark, sf)), path)
    levels = context.learn_levels(readers.read_split(spark, path, "train"))
    rows = readers.read_xy(spark, path, "test", levels.where("NOT (column = 'mcc_category' AND level = 'signup')"))
    return check_roles(rows).select("id", "is_fraud", F.round("abs_amount", 6).alias("abs_amount"), "hour", "mcc_category", "card_brand", "error_kind")


@query(f"""WITH {FRAME} SELECT id, CASE WHEN id % 5 < 3 THEN CAST(0 AS DOUBLE) ELSE round(abs_amount, 6) END AS amount,
  CASE WHEN id % 5 < 3 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS missing FROM f""")
def coerced_numbers(spark, sf):
    """Numbers that come as text: what is no number is missing, flagged for the learners that take no NULL."""
    shown = (F.when(F.col("id") % 5 == 0, "n/a").when(F.col("id") % 5 == 1, "").when(F.col("id") % 5 == 2, "NaN")
             .otherwise(F.concat(F.lit(" "), F.col("abs_amount").cast("string"))))
    made = modelling.model_inputs(frame(spark, sf).withColumn("abs_amount", shown), "forest", {})
    return made.select("id", F.round("_x_abs_amount", 6).alias("amount"), F.col("_na_abs_amount").alias("missing"))


# --------------------------------------------------------------------- fitted tables


@query(f"SELECT * FROM ({preparing._MEDIANS}) WHERE scope <> 'card'")
def stored_medians(spark, sf):
    """Medians by category and overall, as the preparing job leaves them."""
    path = scratch(spark, "medians")
    fitted = medians.fit(splits.time_split(transactions(spark, sf)).where("split = 'train'"))
    sinks.write_small(fitted.category, f"{path}/category")
    sinks.write_small(fitted.overall, f"{path}/overall")
    category, overall = (spark.read.parquet(f"{path}/{name}") for name in ("category", "overall"))
    med = F.round("med", 6).alias("med")
    return category.select(F.lit("category").alias("scope"), F.col("mcc_category").alias("level"), med).unionByName(
        overall.select(F.lit("global").alias("scope"), F.lit("").alias("level"), med))


@query(preparing.Q["distinct_levels"][1])
def stored_levels(spark, sf):
    """The levels document of the training job, in the order of their codes."""
    path = scratch(spark, "levels")
    sinks.write_document(spark, path, requests.levels_dict(context.learn_levels(enriched(spark, sf))))
    doc = spark.read.text(path).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("column", "levels"))
    return doc.select("column", F.posexplode("levels").alias("code", "level"))


@query(preparing.Q["split_summary"][1])
def stored_summary(spark, sf):
    """The split summary as a JSON report."""
    path = scratch(spark, "summary")
    sinks.write_small(splits.split_summary(splits.time_split(transactions(spark, sf))), path, "json")
    s = spark.read.schema("split string, rows long, fraud long, fraud_rate double, start timestamp, end timestamp").json(path)
    text = lambda c: F.date_format(c, parsing.DATE_FORMAT).alias(c)
    return s.select("split", "rows", "fraud", F.round("fraud_rate", 8).alias("fraud_rate"), text("start"), text("end"))


@query(f"""SELECT 'rate' AS part, feature, level, fraud_rate, n FROM ({deciding.Q['category_rates'][1]})
  UNION ALL SELECT 'band', NULL, NULL, fraud_rate, n FROM ({deciding.Q['score_bands'][1]})""")
def stored_context(spark, sf):
    """Base rates and score bands of a context that was built, saved, loaded and saved again."""
    first, second = scratch(spark, "context"), scratch(spark, "context")
    scored = transactions(spark, sf).withColumn("score", F.col("score_b"))
    context.save(context.build(frame(spark, sf), 10, scored), spark, first)
    context.save(context.load(spark, first), spark, second)
    rates, bands = (spark.read.parquet(f"{second}/{name}") for name in ("category_rates", "score_bands"))
    rate = F.round("fraud_rate", 9).alias("fraud_rate")
    return rates.select(F.lit("rate").alias("part"), "feature", "level", rate, "n").unionByName(
        bands.select(F.lit("band").alias("part"), F.lit(None).cast("string").alias("feature"), F.lit(None).cast("string").alias("level"), rate, "n"))


def _assessed(spark, sf, path, knots=((), ())):
    """An assessment with the given calibration, saved."""
    t = transactions(spark, sf)
    xs, ys = knots
    sweep = metrics.cost_sweep(t, score="score_b")
    best = metrics.cheapest(sweep).first()
    point = OperatingPoint(block=best["threshold"], review=best["threshold"] / 2, model="ensemble", calibrator="isotonic", knots_x=tuple(xs), knots_y=tuple(ys))
    report = {"cost_optimal": {"precision": best["precision"], "recall": best["recall"]}}
    assess.save(assess.Assessment(point, {"a": 0.25, "b": 0.75}, report, metrics.cheapest(sweep), sweep, t, t), path)


@query(measuring.Q["cost_sweep"][1])
def stored_sweep(spark, sf):
    """The threshold sweep as the CSV report of an assessment."""
    path = scratch(spark, "assessment")
    _assessed(spark, sf, path)
    shape = metrics.cost_sweep(transactions(spark, sf), score="score_b").schema
    return measuring._money_rounded(spark.read.schema(shape).option("header", True).csv(f"{path}/threshold_sweep"))


@query(f"""SELECT x, y, 'isotonic' AS calibrator, 'ensemble' AS model, CAST(0.75 AS DOUBLE) AS weight_b FROM ({measuring.Q['isotonic_fit'][1]})""")
def stored_calibrator(spark, sf):
    """The operating point that an assessment saves: calibrator, shipped model and blend weights."""
    path = scratch(spark, "assessment")
    _assessed(spark, sf, path, fit_isotonic(splits.val_cut(splits.time_split(transactions(spark, sf))).where("split = 'val_fit'")))
    point, blend = assess.load_point(spark, path)
    knots = spark.read.parquet(f"{path}/calibrator")
    return knots.select(F.round("x", 8).alias("x"), F.round("y", 6).alias("y"), F.lit(point.calibrator).alias("calibrator"),
                        F.lit(point.model).alias("model"), F.lit(blend["b"]).alias("weight_b"))


# ------------------------------------------------------------------------------ logs


@query(f"""SELECT 'quarantined' AS place, reject_reason, count(*) AS requests, CAST(NULL AS DOUBLE) AS amount
  FROM ({deciding.Q['rejected_requests'][1]}) WHERE reject_reason IS NOT NULL GROUP BY reject_reason
  UNION ALL SELECT 'sound', NULL, count(*), round(sum(amount), 2) FROM ({deciding.Q['rejected_requests'][1]}) WHERE reject_reason IS NULL""")
def quarantined_requests(spark, sf):
    """A batch of requests: the malformed go to a log with their reason, the sound ones on."""
    path = scratch(spark, "quarantine")
    sound = sinks.quarantine(requests.parse_json(deciding.request_bodies(spark, sf)), path)
    log = readers.read_log(spark, path, "body string, reject_reason string")
    n = F.count(F.lit(1)).alias("requests")
    return log.groupBy(F.lit("quarantined").alias("place"), "reject_reason").agg(n).withColumn("amount", F.lit(None).cast("double")).unionByName(
        sound.agg(n, F.round(F.sum("amount"), 2).alias("amount")).select(F.lit("sound").alias("place"), F.lit(None).cast("string").alias("reject_reason"), "requests", "amount"))


@query(f"""WITH {_REVIEW} SELECT 'queue' AS log, request_id, action FROM done UNION ALL SELECT 'audit', request_id, action FROM done
  UNION ALL SELECT 'rejects', request_id, action FROM res WHERE id NOT IN (SELECT id FROM done)""")
def resolution_logs(spark, sf):
    """A batch of resolutions in the logs: accepted ones in the queue's log with an audit row each, the others apart."""
    queue, audit, rejects = (scratch(spark, name) for name in ("queue", "audit", "rejects"))
    cases = review_cases(deciding._decided(spark, sf), POINT, F.date_format("date", "yyyy-MM-dd HH:mm:ss"))
    review.resolve_and_log(cases, deciding._resolutions(spark, sf), queue, audit, rejects)
    row = lambda name, path, action: readers.read_log(spark, path, f"request_id string, {action} string").select(
        F.lit(name).alias("log"), "request_id", F.col(action).alias("action"))
    return row("queue", queue, "action").unionByName(row("audit", audit, "review_action")).unionByName(row("rejects", rejects, "action"))
