"""Queries: reference context, evidence, request features, decisions, audit and review logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.functions import features, hashing, parsing, text
from riskloom.operators import context, decisions, lookup, requests, review, splits, weights
from riskloom.operators.decisions import OperatingPoint
from riskloom.operators.ordering import quantile_list
from riskloom.schema import FEATURES, LABELS, label_of
from riskloom.workload.measuring import rounded
from riskloom.workload.tables import ENRICHED, TXN, enriched, read, split_sql, transactions

Q: dict = {}


def query(sql: str | None = None):
    def keep(fn):
        Q[fn.__name__] = (fn, sql)
        return fn
    return keep


def frame(spark, sf):
    """Transactions with every numeric and categorical feature and the label."""
    e = enriched(spark, sf)
    return e.withColumns({
        **{n: c for n, c in features.calendar(F.col("date")).items() if n in ("hour", "is_night")},
        "log_amount": F.log1p("abs_amount"),
        "amount_to_credit_limit": features.safe_ratio(F.col("abs_amount"), F.col("credit_limit")),
        "amount_vs_mcc_median": F.col("abs_amount") / F.lit(60.0),
    })


FRAME = f"""{ENRICHED}, f AS (SELECT e.*, CAST(hour(date) AS INTEGER) AS hour, CAST(hour(date) < 6 AS INTEGER) AS is_night,
  ln(1 + abs_amount) AS log_amount, abs_amount / nullif(credit_limit, 0) AS amount_to_credit_limit,
  abs_amount / CAST(60 AS DOUBLE) AS amount_vs_mcc_median FROM e)"""

# ------------------------------------------------------------------ reference context


@query(f"""WITH {TXN}, a AS (SELECT is_fraud, power(0.5, (epoch_us((SELECT max(date) FROM t)) - epoch_us(date)) / 86400000000.0 / 10.0) AS w FROM t)
  SELECT round(sum(w * is_fraud) / sum(w), 9) AS rate FROM a""")
def weighted_rate(spark, sf):
    t = weights.recency_weight(transactions(spark, sf), 10, into="weight")
    return rounded(context.overall_rate(t, "weight"))


_KNOT_COLS = ["abs_amount", "amount_to_credit_limit", "hour", "is_online"]


@query(f"""WITH {FRAME}, l AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM f WHERE is_fraud = 0" for c in _KNOT_COLS)}),
  q AS (SELECT feature, quantile_cont(v, list_transform(range(0, 101), lambda i: i / CAST(100 AS DOUBLE))) AS vs FROM l WHERE v IS NOT NULL GROUP BY feature)
  SELECT feature, (i - 1) / CAST(100 AS DOUBLE) AS q, round(vs[i], 8) AS value FROM q, range(1, 102) g(i)""")
def percentile_knots(spark, sf):
    """101 percentiles of legitimate rows per feature; rows with a missing value are left out."""
    return context.percentile_knots(frame(spark, sf), _KNOT_COLS)


@query()
def percentile_knots_sketch(spark, sf):
    """The fixed-memory variant of the same table (approximate by choice)."""
    return context.percentile_knots(frame(spark, sf), _KNOT_COLS, accuracy=10_000)


def _levels_sql(src: str) -> str:
    cats = ["use_chip", "mcc_category", "card_brand", "card_type", "error_kind"]
    flags = ["is_online", "is_night", "has_error", "has_chip"]
    parts = [f"SELECT '{c}' AS feature, {c} AS level, is_fraud AS y, w FROM {src}" for c in cats]
    parts += [f"SELECT '{c}', CASE WHEN {c} >= 0.5 THEN 'yes' ELSE 'no' END, is_fraud, w FROM {src}" for c in flags]
    return " UNION ALL ".join(parts)


_RATES = f"""WITH {FRAME}, fw AS (SELECT *, power(0.5, (epoch_us((SELECT max(date) FROM f)) - epoch_us(date)) / 86400000000.0 / 10.0) AS w FROM f),
  l AS ({_levels_sql('fw')}), cr AS (SELECT feature, level, CASE WHEN sum(w) > 0 THEN sum(w * y) / sum(w) ELSE avg(y) END AS r, count(*) AS n
  FROM l WHERE level IS NOT NULL GROUP BY feature, level HAVING count(*) >= 200)"""


@query(f"{_RATES} SELECT feature, level, round(r, 9) AS fraud_rate, n FROM cr")
def category_rates(spark, sf):
    w = weights.recency_weight(frame(spark, sf), 10, into="weight")
    return rounded(context.category_rates(w))


@query(f"""{_RATES}, k AS (SELECT feature, level, r, n, row_number() OVER (PARTITION BY feature ORDER BY r DESC, level) AS place FROM cr)
  SELECT feature, level, round(r, 9) AS fraud_rate, n, CAST(place AS INTEGER) AS place FROM k WHERE place <= 3""")
def riskiest_levels(spark, sf):
    w = weights.recency_weight(frame(spark, sf), 10, into="weight")
    return rounded(context.riskiest_levels(context.category_rates(w)))


_BANDS = """b AS (SELECT * FROM (VALUES (0, 0.0, 0.001), (1, 0.001, 0.005), (2, 0.005, 0.02), (3, 0.02, 0.05), (4, 0.05, 0.1),
  (5, 0.1, 0.25), (6, 0.25, 0.5), (7, 0.5, 1.01)) v(band, lo, hi))"""


@query(f"""WITH {TXN}, {_BANDS} SELECT band, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, count(id) AS n,
  CAST(coalesce(sum(is_fraud), 0) AS BIGINT) AS frauds, round(CAST(sum(is_fraud) AS DOUBLE) / nullif(count(id), 0), 9) AS fraud_rate
  FROM b LEFT JOIN t ON score_b >= CAST(lo AS DOUBLE) AND score_b < CAST(hi AS DOUBLE) GROUP BY band, lo, hi""")
def score_bands(spark, sf):
    return rounded(context.score_bands(transactions(spark, sf), "score_b"), skip=("lo", "hi"))


@query(f"""WITH {TXN}, {_BANDS}, m AS (SELECT id, score * 1.2 AS s FROM t)
  SELECT id, CAST(coalesce(band, 7) AS INTEGER) AS band FROM m LEFT JOIN b ON s >= CAST(lo AS DOUBLE) AND s < CAST(hi AS DOUBLE)""")
def band_lookup(spark, sf):
    """Each score's band; a score beyond the last band belongs to the last one."""
    t = transactions(spark, sf).withColumn("s", F.col("score") * 1.2)
    return lookup.band_of(t, context.BAND_EDGES, "s", "band").select("id", "band")


@query(f"""WITH {TXN}, q AS (SELECT quantile_cont(abs_amount, list_transform(range(0, 101), lambda i: i / CAST(100 AS DOUBLE))) AS vs FROM t WHERE is_fraud = 0),
  k AS (SELECT i, vs[i] AS x, vs[i + 1] AS x2 FROM q, range(1, 101) g(i)),
  m AS (SELECT vs[1] AS lo, vs[101] AS hi FROM q)
  SELECT id, round(CASE WHEN v <= lo THEN 0 WHEN v >= hi THEN 1
    ELSE (i - 1) / CAST(100 AS DOUBLE) + (v - x) / (x2 - x) / 100 END, 7) AS percentile
  FROM (SELECT id, round(abs_amount, 0) AS v FROM t) z CROSS JOIN m LEFT JOIN k ON v >= x AND v < x2""")
def percentile_lookup(spark, sf):
    """Where each value lies among legitimate ones, including values beyond both ends."""
    t = transactions(spark, sf)
    knots = quantile_list(t.where("is_fraud = 0"), "abs_amount", context.PERCENTILES)
    out = lookup.percentile_of(t.withColumn("v", F.round("abs_amount", 0)), knots, "v", "p")
    return out.select("id", F.round("p", 7).alias("percentile"))


# ---------------------------------------------------------------------------- display


@query(f"""WITH {TXN} SELECT id, CASE WHEN id % 13 = 0 THEN 'n/a' ELSE format('{{:.2f}}%', score * 100) END AS percent,
  CASE WHEN score - score_b < 0 THEN '' ELSE '+' END || format('{{:.2f}}%', (score - score_b) * 100) AS signed,
  format('{{:,.0f}}', amount * 1000) AS money, format('{{:,.1f}}x', amount * 10) AS times FROM t""")
def display_numbers(spark, sf):
    t = transactions(spark, sf)
    return t.select(
        "id", text.percent(F.when(F.col("id") % 13 != 0, F.col("score"))).alias("percent"),
        text.signed_percent(F.col("score") - F.col("score_b")).alias("signed"),
        text.money_text(F.col("amount") * 1000).alias("money"), text.times(F.col("amount") * 10).alias("times"))


@query(f"""WITH {FRAME} SELECT id, format('{{:,.2f}}', abs_amount) AS abs_amount, format('{{:02d}}:00', hour) AS hour,
  CASE WHEN is_online = 1 THEN 'yes' ELSE 'no' END AS is_online, coalesce(card_brand, 'not provided') AS card_brand,
  CASE WHEN amount_to_credit_limit IS NULL THEN 'not provided' ELSE format('{{:.4g}}', amount_to_credit_limit) END AS ratio,
  coalesce(CASE mcc_category WHEN 'error' THEN 'amount vs this card''s usual spend' ELSE mcc_category END) AS label FROM f""")
def display_values(spark, sf):
    """Feature values and labels as a reviewer sees them."""
    f = frame(spark, sf)
    shown = lambda c: text.feature_value(c, F.col(c)).alias(c)
    name = F.when(F.col("mcc_category") == "error", "amount_vs_card_median").otherwise(F.col("mcc_category"))
    return f.select("id", shown("abs_amount"), shown("hour"), shown("is_online"), shown("card_brand"),
                    text.feature_value("amount_to_credit_limit", F.col("amount_to_credit_limit")).alias("ratio"),
                    label_of(name).alias("label"))


def _small_context(spark, sf):
    f = frame(spark, sf)
    train = f.withColumn("weight", F.lit(1.0))
    knots = context.percentile_knots(f, ["abs_amount"])
    rates = context.category_rates(train, columns=["mcc_category", "is_online"])
    rate = context.overall_rate(train, "weight").first()[0]
    return f, context.load_context(knots, rates, context.score_bands(f), rate, f.where("is_fraud = 0").count())


_EVIDENCE = f"""WITH {FRAME}, o AS (SELECT avg(is_fraud) AS o FROM f),
  r AS (SELECT mcc_category AS level, avg(is_fraud) AS r, count(*) AS n FROM f GROUP BY 1),
  q AS (SELECT list_transform(quantile_cont(abs_amount, list_transform(range(0, 101), lambda i: i / CAST(100 AS DOUBLE))), lambda x: round(x, 8)) AS vs FROM f WHERE is_fraud = 0),
  k AS (SELECT i, vs[i] AS x, vs[i + 1] AS x2 FROM q, range(1, 101) g(i)), m AS (SELECT vs[1] AS lo, vs[101] AS hi FROM q),
  p AS (SELECT id, abs_amount AS v, CASE WHEN abs_amount <= lo THEN 0 WHEN abs_amount >= hi THEN 1
    ELSE (i - 1) / CAST(100 AS DOUBLE) + (i / CAST(100 AS DOUBLE) - (i - 1) / CAST(100 AS DOUBLE)) / (x2 - x) * (abs_amount - x) END AS pct
    FROM f CROSS JOIN m LEFT JOIN k ON abs_amount >= x AND abs_amount < x2)"""


@query(f"""{_EVIDENCE} SELECT f.id, round(r / o, 2) AS lift, round(pct, 6) AS percentile,
  CASE WHEN r IS NULL THEN 'merchant category = ' || mcc_category || ': too few rows to compare'
   ELSE 'merchant category = ' || mcc_category || ': fraud in ' || format('{{:.2f}}%', r * 100) || ' of ' || format('{{:,}}', n) || ' rows, '
   || format('{{:.2f}}%', o * 100) || ' in all rows' || CASE WHEN r / o >= 1.5 THEN ', ' || format('{{:.1f}}', r / o) || ' times as much' ELSE '' END END AS category_evidence,
  'transaction size (ignoring refund sign) = ' || format('{{:,.2f}}', p.v) || ': ' || CASE WHEN pct >= 0.5 THEN 'above' ELSE 'below' END
   || ' ' || format('{{:.1f}}', (CASE WHEN pct >= 0.5 THEN pct ELSE 1 - pct END) * 100) || '% of rows without fraud' AS amount_evidence
  FROM f JOIN p ON f.id = p.id LEFT JOIN r ON f.mcc_category = r.level AND n >= 200 CROSS JOIN o""")
def evidence_text(spark, sf):
    """One sentence of evidence per feature value: base rate and lift, or a percentile."""
    f, ctx = _small_context(spark, sf)
    cat, num = context.evidence("mcc_category", ctx), context.evidence("abs_amount", ctx)
    return context.with_level_rates(context.with_percentiles(f, ctx), ctx, ["mcc_category"]).select(
        "id", cat["lift"].alias("lift"), num["percentile"].alias("percentile"),
        cat["evidence"].alias("category_evidence"), num["evidence"].alias("amount_evidence"))


_NOTES = (f"CASE WHEN up AND lift < 1.0 THEN '{decisions.RAISED_ANYWAY}' WHEN NOT up AND lift > 1.5 "
          f"THEN '{decisions.LOWERED_ANYWAY}' ELSE '' END")


@query(f"""WITH {TXN}, z AS (SELECT id, id % 2 = 0 AS up, CASE WHEN id % 5 <> 0 THEN score * 3 END AS lift FROM t)
  SELECT id, {_NOTES} AS note FROM z""")
def disagreement_note(spark, sf):
    t = transactions(spark, sf)
    lift = F.when(F.col("id") % 5 != 0, F.col("score") * 3)
    return t.select("id", decisions.disagreement(F.col("id") % 2 == 0, lift).alias("note"))


# ----------------------------------------------------------------- requests


def _requests(spark, sf):
    """The transactions as scoring requests, with gaps of every kind."""
    e = enriched(spark, sf)
    gap = lambda n, c: F.when(F.col("id") % n != 0, c)
    return requests.as_requests(e.select(
        "id", F.col("id").cast("string").alias("request_id"), "amount",
        F.when(F.col("id") % 17 == 0, "yesterday").otherwise(gap(4, F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"))).alias("date"),
        gap(5, F.col("use_chip")).alias("use_chip"), F.lit(None).cast("string").alias("merchant_state"), "zip",
        (F.col("k") % 6).alias("mcc"), gap(3, F.col("mcc_category")).alias("mcc_category"), "errors",
        F.when(F.col("id") % 6 == 0, F.lit(0.0)).otherwise(F.col("credit_limit")).alias("credit_limit"),
        gap(8, F.col("card_brand")).alias("card_brand"), "card_type",
        gap(9, F.col("has_chip").cast("boolean")).alias("has_chip"),
        F.when(F.col("id") % 10 == 0, F.col("id") % 20 == 0).alias("is_online")))


def _dictionaries(spark, sf):
    names = read(spark, sf, "region").select(F.col("r_regionkey").alias("mcc"), F.lower("r_name").alias("name"))
    # Medians of two categories only, so that the global fallback is exercised as well.
    med = spark.createDataFrame([("view", 50.0), ("click", 0.0)], "mcc_category string, med double")
    return requests.Dictionaries(names, med, 40.0, {"card_brand": ["BUILDING", "FURNITURE", "MACHINERY"]})


_REQ = f"""{ENRICHED}, q AS (SELECT id, amount, date AS d, zip, errors,
  CASE WHEN id % 17 = 0 THEN 'yesterday' WHEN id % 4 <> 0 THEN strftime(date, '%Y-%m-%dT%H:%M:%S') END AS date,
  CASE WHEN id % 5 <> 0 THEN use_chip END AS use_chip, k % 6 AS mcc, CASE WHEN id % 3 <> 0 THEN mcc_category END AS mcc_category,
  CASE WHEN id % 6 = 0 THEN 0 ELSE credit_limit END AS credit_limit, CASE WHEN id % 8 <> 0 THEN card_brand END AS card_brand, card_type,
  CASE WHEN id % 9 <> 0 THEN CAST(has_chip AS DOUBLE) END AS has_chip,
  CASE WHEN id % 10 = 0 THEN CAST(id % 20 = 0 AS DOUBLE) END AS is_online FROM e),
  x AS (SELECT q.*, coalesce(mcc_category, lower(r_name)) AS cat FROM q LEFT JOIN region ON mcc = r_regionkey)"""


@query(f"""WITH {_REQ} SELECT id, round(abs(amount), 6) AS abs_amount, round(abs(amount) / nullif(credit_limit, 0), 9) AS amount_to_credit_limit,
  round(abs(amount) / CASE cat WHEN 'view' THEN 50 ELSE 40 END, 9) AS amount_vs_mcc_median,
  CASE WHEN date LIKE '2%' THEN CAST(hour(d) AS DOUBLE) END AS hour, CASE WHEN date LIKE '2%' THEN CAST(hour(d) < 6 AS DOUBLE) END AS is_night,
  coalesce(is_online, CAST(zip IS NULL OR zip = 0 AS DOUBLE)) AS is_online, CAST(errors IS NOT NULL AS DOUBLE) AS has_error, has_chip,
  use_chip, cat AS mcc_category, CASE WHEN card_brand IN ('BUILDING', 'FURNITURE', 'MACHINERY') THEN card_brand END AS card_brand, card_type,
  CASE WHEN errors IS NOT NULL THEN 'Bad PIN' ELSE 'none' END AS error_kind FROM x""")
def request_features(spark, sf):
    f = requests.featurize(_requests(spark, sf), _dictionaries(spark, sf))
    return f.select("id", *[c for c in FEATURES if c != "log_amount"]).withColumns({
        "abs_amount": F.round("abs_amount", 6), "amount_to_credit_limit": F.round("amount_to_credit_limit", 9),
        "amount_vs_mcc_median": F.round("amount_vs_mcc_median", 9)})


@query(f"""WITH {_REQ} SELECT id, concat_ws(',', CASE WHEN card_brand IS NULL THEN 'card_brand' END, CASE WHEN card_type IS NULL THEN 'card_type' END,
  CASE WHEN credit_limit IS NULL OR credit_limit = 0 THEN 'credit_limit' END, CASE WHEN date IS NULL OR date = 'yesterday' THEN 'date' END,
  CASE WHEN cat IS NULL THEN 'mcc,mcc_category' END, CASE WHEN use_chip IS NULL THEN 'use_chip' END) AS missing FROM x""")
def missing_fields(spark, sf):
    f = requests.featurize(_requests(spark, sf), _dictionaries(spark, sf))
    return f.select("id", F.concat_ws(",", "missing_fields").alias("missing"))


@query(f"""WITH {_REQ} SELECT id, CAST(CASE WHEN use_chip LIKE '%Online%' THEN 1 ELSE 0 END AS DOUBLE) AS by_use,
  coalesce(is_online, CAST(CASE WHEN use_chip LIKE '%Online%' THEN 1 ELSE 0 END AS DOUBLE)) AS is_online FROM x""")
def online_without_zip(spark, sf):
    """Requests from a caller that sends no ZIP field at all."""
    r = _requests(spark, sf)
    return r.select(
        "id", requests.card_not_present(F.lit(None).cast("boolean"), F.col("zip"), F.col("use_chip"), False).alias("by_use"),
        requests.card_not_present(F.col("is_online"), F.col("zip"), F.col("use_chip"), False).alias("is_online"))


def request_bodies(spark, sf):
    """Requests as text, six of nine malformed."""
    e = read(spark, sf, "events")
    v = hashing.plain_number(F.col("value"))
    m = F.col("event_id") % 9
    good = F.concat(F.lit('{"amount": '), v, F.lit(', "unknown_key": 1, "mcc": "5812"}'))
    body = (F.when(m == 0, '{"mcc": 5812}').when(m == 1, '{"amount": "abc"}').when(m == 2, '{"amount": "Infinity"}')
            .when(m == 3, '{"amount": 1e12}').when(m == 4, F.concat(F.lit('{"amount": '), v, F.lit(', "mcc": "not-a-code"}')))
            .when(m == 5, "{broken").otherwise(good))
    return e.select(F.col("event_id").alias("id"), body.alias("body"))


@query("""SELECT id, CASE id % 9 WHEN 0 THEN 'amount is required' WHEN 1 THEN 'amount has the wrong type' WHEN 2 THEN 'amount must be a finite number'
  WHEN 3 THEN 'amount is implausibly large' WHEN 4 THEN 'mcc has the wrong type' WHEN 5 THEN 'not a JSON object' END AS reject_reason,
  CASE WHEN id % 9 >= 6 THEN v END AS amount FROM (SELECT event_id AS id, value AS v FROM events)""")
def rejected_requests(spark, sf):
    """Malformed requests are named and set apart, well-formed ones pass."""
    out = requests.parse_json(request_bodies(spark, sf))
    return out.select("id", "reject_reason", F.when(F.col("reject_reason").isNull(), F.col("amount")).alias("amount"))


@query(f"""WITH {FRAME} SELECT id, abs_amount AS amount, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, use_chip, mcc_category,
  CASE WHEN error_kind <> 'none' THEN error_kind END AS errors, CASE WHEN abs_amount > 0 THEN round(credit_limit, 6) END AS credit_limit, has_chip = 1 AS has_chip,
  is_online = 1 AS is_online FROM f""")
def request_rebuild(spark, sf):
    """Requests recovered from stored features: the limit comes back from its ratio."""
    r = requests.to_request(frame(spark, sf))
    return r.select("id", "amount", "date", "use_chip", "mcc_category", "errors",
                    F.round("credit_limit", 6).alias("credit_limit"), "has_chip", "is_online")


_PAIRS = """'amount=' || CAST(amount AS VARCHAR) || '|date=' || strftime(date, '%Y-%m-%dT%H:%M:%S') || '|errors=' || coalesce(errors, 'None')
  || '|is_online=' || CASE WHEN is_online = 1 THEN 'True' ELSE 'False' END || '|mcc=' || k || '|zip=' || coalesce(CAST(zip AS VARCHAR), 'None')"""


@query(f"WITH {ENRICHED} SELECT id, sha256({_PAIRS}) AS input_sha256 FROM e")
def input_hash(spark, sf):
    r = enriched(spark, sf).select(
        "id", "amount", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), "errors", "zip",
        F.col("k").alias("mcc"), F.col("is_online").cast("boolean").alias("is_online"))
    return r.select("id", hashing.fingerprint(r).alias("input_sha256"))


# -------------------------------------------------------------- decisions and logs

POINT = OperatingPoint(block=0.56, review=0.45, model="stand-in")
_BAND = """CASE WHEN score >= CAST(0.56 AS DOUBLE) THEN 'block' WHEN score >= CAST(0.45 AS DOUBLE) THEN 'review' ELSE 'allow' END"""
_RULE = """CASE {d} WHEN 'block' THEN 'RULE_BLOCK_ABOVE_COST_OPTIMAL_THRESHOLD' WHEN 'review' THEN 'RULE_REVIEW_BAND_BELOW_BLOCK_THRESHOLD'
  ELSE 'RULE_ALLOW_BELOW_REVIEW_BAND' END"""


def _decided(spark, sf):
    t = transactions(spark, sf)
    out = decisions.decide(t.withColumn("raw_score", F.col("score")), POINT)
    return out.withColumns({
        "request_id": F.col("id").cast("string"), "request_category": F.col("mcc_category"),
        "input_sha256": F.sha2(F.concat(F.lit("amount="), hashing.plain_number(F.col("amount"))), 256),
        "missing_fields": F.array(F.lit("mcc")),
        "base_rate": F.lit(None).cast("struct<lo:double,hi:double,n:bigint,frauds:bigint,fraud_rate:double>"),
        "top_factors": F.array().cast("array<struct<feature:string,contribution:double,direction:string,evidence:string>>"),
    })


@query(f"WITH {TXN}, d AS (SELECT id, round(score, 6) AS risk_score, format('{{:.2f}}%', score * 100) AS risk_percent, {_BAND} AS decision FROM t) "
       f"SELECT *, {_RULE.format(d='decision')} AS rule_id FROM d")
def band_decision(spark, sf):
    return _decided(spark, sf).select("id", "risk_score", "risk_percent", "decision", "rule_id")


@query(f"""WITH {TXN}, d AS (SELECT *, {_BAND} AS dec FROM t)
  SELECT strftime(date, '%Y-%m-%d %H:%M:%S') AS ts, CAST(id AS VARCHAR) AS request_id, sha256('amount=' || CAST(amount AS VARCHAR)) AS input_sha256, amount,
   round(score, 6) AS risk_score, dec AS decision, dec AS raw_decision, FALSE AS gated, CAST(NULL AS VARCHAR) AS gate_reason, {_RULE.format(d='dec')} AS rule_id,
   CAST(0.56 AS DOUBLE) AS threshold_used, CAST(0.45 AS DOUBLE) AS review_threshold, 'frm-1.0.0' AS model_version, 'stand-in' AS scored_by, 'none' AS calibrator,
   '' AS top_factors, 'mcc' AS missing_fields, CAST(NULL AS DOUBLE) AS latency_ms FROM d""")
def audit_rows(spark, sf):
    rows = decisions.audit_rows(_decided(spark, sf), POINT, F.date_format("date", parsing.DATE_FORMAT))
    return rows.withColumns({"top_factors": F.concat_ws(",", "top_factors"), "missing_fields": F.concat_ws(",", "missing_fields")})


@query(f"""WITH {TXN}, d AS (SELECT *, {_BAND} AS dec FROM t)
  SELECT CAST(id AS VARCHAR) AS request_id, round(score, 6) AS risk_score, format('{{:.2f}}%', score * 100) AS risk_percent, dec AS decision, dec AS raw_decision,
   FALSE AS gated, CAST(NULL AS VARCHAR) AS gate_reason, '' AS top_factors, {_RULE.format(d='dec')} AS rule_id, CAST(0.45 AS DOUBLE) AS review_threshold,
   CAST(0.56 AS DOUBLE) AS block_threshold, 'frm-1.0.0' AS model_version, 'stand-in' AS scored_by, 'none' AS explained_by, 'mcc' AS missing_fields,
   CAST(1.5 AS DOUBLE) AS latency_ms, CAST(NULL AS DOUBLE) AS base_rate FROM d""")
def score_responses(spark, sf):
    """The full response to every request."""
    rows = decisions.responses(_decided(spark, sf), POINT, 1.5)
    return rows.withColumns({"top_factors": F.concat_ws(",", F.transform("top_factors", lambda x: x["feature"])), "missing_fields": F.concat_ws(",", "missing_fields"),
                             "review_threshold": F.col("thresholds.review"), "block_threshold": F.col("thresholds.block"), "base_rate": F.col("base_rate.fraud_rate")}).drop("thresholds")


@query(f"""WITH {TXN}, d AS (SELECT {_BAND} AS dec FROM t) SELECT count(*) AS decisions, round(avg(CAST(dec = 'block' AS INTEGER)), 9) AS block_share,
  round(avg(CAST(dec = 'review' AS INTEGER)), 9) AS review_share, round(avg(CAST(dec = 'hold' AS INTEGER)), 9) AS hold_share FROM d""")
def audit_kpis(spark, sf):
    return rounded(decisions.audit_kpis(_decided(spark, sf)))


@query(f"""WITH {TXN} SELECT strftime(date, '%Y-%m-%d %H:%M:%S.%f') AS "when", format('{{:.2f}}%', round(score, 6) * 100) AS risk, {_BAND} AS outcome, amount
  FROM t ORDER BY date DESC LIMIT 200""")
def audit_recent(spark, sf):
    """The 200 newest decisions (the feature is a top-n report)."""
    return decisions.recent(_decided(spark, sf).withColumn("ts", F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSS")))


@query(f"""WITH {TXN}, d AS (SELECT is_fraud, {_BAND} AS dec FROM t) SELECT dec AS decision, is_fraud, (is_fraud = 1) = (dec <> 'allow') AS correct, count(*) AS n
  FROM d GROUP BY 1, 2, 3""")
def outcome_vs_truth(spark, sf):
    return decisions.outcome(_decided(spark, sf)).groupBy("decision", "is_fraud", "correct").agg(F.count(F.lit(1)).alias("n"))


def _resolutions(spark, sf):
    t = transactions(spark, sf).where(F.col("id") % 3 == 0)
    action = F.when(F.col("id") % 15 == 0, "escalate").when(F.col("k") % 2 == 0, "approve").otherwise("decline")
    return t.select(
        F.col("id").cast("string").alias("request_id"), F.date_format(F.expr("date + interval 1 hour"), "yyyy-MM-dd HH:mm:ss").alias("ts"),
        action.alias("action"), F.when(F.col("id") % 2 == 0, "ana").alias("reviewer"), F.lit("").alias("note"))


def _log(spark, sf):
    """The review log after one round of resolutions."""
    cases = decisions.review_cases(_decided(spark, sf), POINT, F.date_format("date", "yyyy-MM-dd HH:mm:ss"))
    done, rejected = review.resolve(cases, _resolutions(spark, sf))
    return cases.unionByName(done, allowMissingColumns=True), done, rejected


_REVIEW = f"""{TXN}, cases AS (SELECT * FROM t WHERE {_BAND} = 'review'),
  res AS (SELECT CAST(id AS VARCHAR) AS request_id, id, CASE WHEN id % 15 = 0 THEN 'escalate' WHEN k % 2 = 0 THEN 'approve' ELSE 'decline' END AS action,
    CASE WHEN id % 2 = 0 THEN 'ana' ELSE 'demo-reviewer' END AS reviewer FROM t WHERE id % 3 = 0),
  done AS (SELECT res.*, round(c.score, 6) AS risk_score FROM res JOIN cases c ON c.id = res.id WHERE action <> 'escalate'),
  pend AS (SELECT * FROM cases WHERE id NOT IN (SELECT id FROM done))"""


@query(f"""WITH {_REVIEW}, twice AS (SELECT request_id, action, n FROM res, (VALUES (1), (2)) c(n))
  SELECT request_id, n - 1 AS nth, CASE WHEN action = 'escalate' THEN 'action must be approve or decline'
    WHEN n = 1 AND request_id IN (SELECT request_id FROM done) THEN 'accepted' ELSE 'no pending review' END AS outcome FROM twice""")
def review_every_resolution(spark, sf):
    """Every resolution comes in twice: each row is accepted once or rejected with a reason."""
    cases = decisions.review_cases(_decided(spark, sf), POINT, F.date_format("date", "yyyy-MM-dd HH:mm:ss"))
    asked = _resolutions(spark, sf)
    done, rejected = review.resolve(cases, asked.union(asked))
    every = done.select("request_id", F.lit("accepted").alias("outcome")).unionByName(rejected.select("request_id", F.col("problem").alias("outcome")))
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy("outcome")) - 1
    return every.select("request_id", nth.alias("nth"), "outcome")


@query(f"""WITH {_REVIEW} SELECT CAST(id AS VARCHAR) AS request_id, round(score, 6) AS risk_score, format('{{:.2f}}%', score * 100) AS risk_percent, amount,
  mcc_category AS merchant_category, 'score in review band' AS queued_reason, 'RULE_REVIEW_BAND_BELOW_BLOCK_THRESHOLD' AS rule_id FROM cases""")
def review_queued(spark, sf):
    cases = decisions.review_cases(_decided(spark, sf), POINT, F.date_format("date", "yyyy-MM-dd HH:mm:ss"))
    return cases.select("request_id", "risk_score", "risk_percent", "amount", "merchant_category", "queued_reason", "rule_id")


@query(f"""WITH {_REVIEW} SELECT request_id, 'human_review_resolved' AS decision, action AS review_action, reviewer, '' AS note, risk_score,
  'RULE_HUMAN_REVIEW_RESOLUTION' AS rule_id, 'frm-1.0.0' AS model_version FROM done""")
def review_resolved(spark, sf):
    _, done, _ = _log(spark, sf)
    return decisions_of(done)


def decisions_of(done):
    return review.resolution_audit(done).drop("ts")


@query(f"""WITH {_REVIEW} SELECT request_id, action, CASE WHEN action = 'escalate' THEN 'action must be approve or decline' ELSE 'no pending review' END AS problem
  FROM res WHERE id NOT IN (SELECT id FROM done)""")
def review_rejected(spark, sf):
    _, _, rejected = _log(spark, sf)
    return rejected.select("request_id", "action", "problem")


@query(f"WITH {_REVIEW} SELECT CAST(id AS VARCHAR) AS request_id, round(score, 6) AS risk_score, amount FROM pend")
def review_pending(spark, sf):
    log, _, _ = _log(spark, sf)
    return review.pending(log).select("request_id", "risk_score", "amount")


@query(f"""WITH {_REVIEW} SELECT (SELECT count(*) FROM done) AS resolved, (SELECT count(*) FROM done WHERE action = 'approve') AS approved,
  (SELECT count(*) FROM done WHERE action = 'decline') AS declined, (SELECT count(*) FROM pend) AS pending""")
def review_stats(spark, sf):
    log, _, _ = _log(spark, sf)
    return review.stats(log)


@query(f"""WITH {_REVIEW} SELECT CAST(id AS VARCHAR) AS request_id, round(score, 6) AS risk_score FROM pend
  ORDER BY round(score, 6) DESC, CAST(id AS VARCHAR) LIMIT 100""")
def pending_top_n(spark, sf):
    """The 100 riskiest open cases (the feature is a top-n report)."""
    log, _, _ = _log(spark, sf)
    return review.list_pending(log, 100).select("request_id", "risk_score")
