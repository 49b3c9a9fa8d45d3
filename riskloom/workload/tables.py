"""The given tables in the roles of the data model, once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import parsing
from riskloom.operators.skew import left_lookup


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # Timestamps of the given tables carry no zone; UTC keeps calendar fields as written.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as card transactions."""
    e = read(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("date"),
        F.col("user_id").alias("card_id"),
        F.col("user_id").alias("client_id"),
        F.col("value").alias("amount"),
        F.abs("value").alias("abs_amount"),
        F.col("event_type").alias("mcc_category"),
        k.alias("k"),
        (k >= 95).cast("int").alias("is_fraud"),
        F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 7).cast("double")).alias("zip"),
        F.when(F.col("event_type") == "error", "Bad PIN,Bad CVV").alias("errors"),
        F.element_at(F.array(*[F.lit(s) for s in ("Chip Transaction", "Swipe Transaction", "Online Transaction")]),
                     (F.col("event_id") % 3 + 1).cast("int")).alias("use_chip"),
        (F.col("value") / (F.col("value") + 100)).alias("score"),
        (((F.col("event_id") * 37) % 100).cast("double") / 100).alias("score_b"),
    )


TXN = """t AS (
  SELECT event_id AS id, ts AS date, user_id AS card_id, user_id AS client_id,
         value AS amount, abs(value) AS abs_amount, event_type AS mcc_category,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 95 THEN 1 ELSE 0 END AS is_fraud,
         CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 7 AS DOUBLE) END AS zip,
         CASE WHEN event_type = 'error' THEN 'Bad PIN,Bad CVV' END AS errors,
         CASE event_id % 3 WHEN 0 THEN 'Chip Transaction' WHEN 1 THEN 'Swipe Transaction'
              ELSE 'Online Transaction' END AS use_chip,
         value / (value + 100) AS score,
         CAST((event_id * 37) % 100 AS DOUBLE) / 100 AS score_b
  FROM events)"""


def cards(spark: SparkSession, sf: str) -> DataFrame:
    """``customer`` as the card table: flags, limits and dates are raw text, as a card file has them."""
    c = read(spark, sf, "customer")
    key = F.col("c_custkey")
    limit = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("$"), F.format_number("c_acctbal", 2)))
    return c.select(
        key.alias("card_id"),
        F.col("c_mktsegment").alias("card_brand"),
        F.element_at(F.array(*[F.lit(s) for s in ("Credit", "Debit", "Debit (Prepaid)")]),
                     (F.col("c_nationkey") % 3 + 1).cast("int")).alias("card_type"),
        F.when(key % 3 == 1, "YES").when(key % 3 == 2, " No ").alias("has_chip"),
        limit.alias("credit_limit"),
        F.concat(F.lpad((key % 12 + 1).cast("string"), 2, "0"), F.lit("/"), (2000 + key % 20).cast("string"))
        .alias("acct_open_date"),
        (2005 + key % 15).cast("string").alias("year_pin_last_changed"),
        F.when(key % 50 == 0, "Yes").otherwise("No").alias("card_on_dark_web"),
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    """``customer`` and ``nation`` as the cardholder table."""
    c = read(spark, sf, "customer").join(
        read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.select(
        F.col("c_custkey").alias("client_id"),
        F.col("n_name").alias("home_state"),
        F.when(F.col("c_acctbal") > 500, F.concat(F.lit("$"), F.format_number(F.col("c_acctbal") * 10, 2)))
        .alias("yearly_income"),
        F.concat(F.lit("$"), F.format_number(F.abs("c_acctbal") * 2, 2)).alias("total_debt"),
    )


CARD = """c AS (
  SELECT c_custkey AS card_id, c_mktsegment AS card_brand,
         CASE c_nationkey % 3 WHEN 0 THEN 'Credit' WHEN 1 THEN 'Debit' ELSE 'Debit (Prepaid)' END AS card_type,
         CASE WHEN c_custkey % 3 = 1 THEN 1 ELSE 0 END AS has_chip,
         CASE WHEN c_acctbal > 0 THEN c_acctbal END AS credit_limit,
         make_date(CAST(2000 + c_custkey % 20 AS BIGINT), CAST(c_custkey % 12 + 1 AS BIGINT), 1) AS opened,
         2005 + c_custkey % 15 AS pin_year,
         CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS card_on_dark_web
  FROM customer)"""
USER = """u AS (
  SELECT c_custkey AS client_id, n_name AS home_state,
         CASE WHEN c_acctbal > 500 THEN round(c_acctbal * 10, 2) END AS yearly_income,
         round(abs(c_acctbal) * 2, 2) AS total_debt
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions joined to cards and users, cleaned: the frame features are built from."""
    t = transactions(spark, sf)
    joined = left_lookup(t, cards(spark, sf), "card_id")
    joined = left_lookup(joined, users(spark, sf), "client_id")
    return joined.withColumns({
        "has_chip": parsing.yes_flag(F.col("has_chip")),
        "card_on_dark_web": parsing.yes_flag(F.col("card_on_dark_web")),
        "credit_limit": parsing.money(F.col("credit_limit")),
        "yearly_income": parsing.money(F.col("yearly_income")),
        "total_debt": parsing.money(F.col("total_debt")),
        "has_error": parsing.has_error(F.col("errors")),
        "error_kind": parsing.error_kind(F.col("errors")),
        "is_online": parsing.card_not_present(F.col("zip")),
        "merchant_state": parsing.merchant_state(F.when(F.col("zip").isNotNull(), F.col("home_state"))),
    }).drop("home_state")


ENRICHED = f"""{TXN}, {CARD}, {USER}, e AS (
  SELECT t.*, c.card_brand, c.card_type, c.has_chip, c.credit_limit, c.opened, c.pin_year, c.card_on_dark_web,
         u.yearly_income, u.total_debt,
         CASE WHEN errors IS NOT NULL AND errors <> '' THEN 1 ELSE 0 END AS has_error,
         CASE WHEN errors IS NOT NULL AND errors <> '' THEN split_part(errors, ',', 1) ELSE 'none' END AS error_kind,
         CASE WHEN zip IS NULL THEN 1 ELSE 0 END AS is_online,
         CASE WHEN zip IS NULL THEN 'ONLINE' ELSE coalesce(u.home_state, 'ONLINE') END AS merchant_state
  FROM t LEFT JOIN c ON t.card_id = c.card_id LEFT JOIN u ON t.client_id = u.client_id)"""

# The four time splits, by rank on (date, id).
SPLIT = """r AS (
  SELECT *, row_number() OVER (ORDER BY date, id) - 1 AS rk, count(*) OVER () AS n FROM {src}),
s AS (
  SELECT *, CASE WHEN rk < a THEN 'train' WHEN rk < a + b THEN 'val'
                 WHEN rk < a + b + d THEN 'test' ELSE 'demo' END AS split
  FROM (SELECT *, floor(n * CAST(0.82 AS DOUBLE)) AS a, floor(n * CAST(0.08 AS DOUBLE)) AS b,
               floor(n * CAST(0.09 AS DOUBLE)) AS d FROM r))"""


def split_sql(src: str = "t") -> str:
    return SPLIT.format(src=src)
