"""Queries: parsing, features, joins, velocity windows, splits, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import features, parsing
from riskloom.operators import context, splits
from riskloom.operators.skew import left_lookup, repeated_keys
from riskloom.operators.velocity import add_velocity
from riskloom.operators import medians
from riskloom.workload.tables import (CARD, ENRICHED, TXN, USER, cards, enriched, read, split_sql,
                                      transactions, users)

Q: dict = {}


def query(sql: str | None = None):
    def keep(fn):
        Q[fn.__name__] = (fn, sql)
        return fn
    return keep


# ------------------------------------------------------------- parsing and row features


@query(f"""WITH {TXN} SELECT id, CASE WHEN id % 11 = 0 THEN NULL
  WHEN id % 2 = 0 THEN -round(amount * 100, 2) ELSE round(amount * 100, 2) END AS parsed FROM t""")
def parse_money(spark, sf):
    t = transactions(spark, sf)
    shown = F.format_number(F.col("amount") * 100, 2)
    text = (F.when(F.col("id") % 11 == 0, F.lit("not a number"))
            .when(F.col("id") % 2 == 0, F.concat(F.lit("$-"), shown)).otherwise(F.concat(F.lit("$"), shown)))
    return t.select("id", parsing.money(text).alias("parsed"))


@query(f"""WITH {TXN}, {CARD} SELECT t.id, c.has_chip, c.card_on_dark_web
  FROM t JOIN c ON t.card_id = c.card_id""")
def parse_flags(spark, sf):
    t = transactions(spark, sf)
    return left_lookup(t, cards(spark, sf), "card_id").select(
        "id", parsing.yes_flag(F.col("has_chip")).alias("has_chip"),
        parsing.yes_flag(F.col("card_on_dark_web")).alias("card_on_dark_web"))


@query("SELECT o_orderkey AS id, epoch_us(o_orderdate) AS us FROM orders")
def parse_timestamp(spark, sf):
    text = F.date_format("o_orderdate", parsing.DATE_FORMAT)
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), features.clock(parsing.instant(text)).alias("us"))


@query(f"""WITH {ENRICHED} SELECT id, has_error, error_kind, is_online, merchant_state FROM e""")
def clean_flags(spark, sf):
    return enriched(spark, sf).select("id", "has_error", "error_kind", "is_online", "merchant_state")


@query(f"""WITH {TXN} SELECT id, CAST(hour(date) AS INTEGER) AS hour,
  CAST((isodow(date) - 1) AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month,
  CAST(month(date) AS INTEGER) AS month, CAST(hour(date) < 6 AS INTEGER) AS is_night,
  CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend FROM t""")
def calendar_features(spark, sf):
    return transactions(spark, sf).select(
        "id", *[c.cast("int").alias(n) for n, c in features.calendar(F.col("date")).items()])


@query("""SELECT o_orderkey AS id, round(abs(v), 2) AS abs_amount, round(ln(1 + abs(v)), 6) AS log_amount,
  CAST(v < 0 AS INTEGER) AS is_refund
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -o_totalprice ELSE o_totalprice END AS v FROM orders)""")
def log_amount(spark, sf):
    o = read(spark, sf, "orders")
    v = F.when(F.col("o_orderkey") % 5 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    f = features.amounts(v)
    return o.select(F.col("o_orderkey").alias("id"), F.round(f["abs_amount"], 2).alias("abs_amount"),
                    F.round(f["log_amount"], 6).alias("log_amount"), f["is_refund"].alias("is_refund"))


@query(f"""WITH {ENRICHED} SELECT id, round(abs_amount / credit_limit, 9) AS amount_to_credit_limit,
  round(abs_amount / yearly_income, 9) AS amount_to_income,
  round(total_debt / yearly_income, 9) AS debt_to_income FROM e""")
def safe_ratios(spark, sf):
    e = enriched(spark, sf)
    r = features.ratios(F.col("abs_amount"), F.col("credit_limit"), F.col("yearly_income"), F.col("total_debt"))
    return e.select("id", *[F.round(c, 9).alias(n) for n, c in r.items()])


@query(f"""WITH {ENRICHED} SELECT id, round(date_diff('day', opened, CAST(date AS DATE)) / 365.25, 6) AS card_age_years,
  CAST(year(date) - pin_year AS DOUBLE) AS years_since_pin_change FROM e""")
def card_age(spark, sf):
    e = enriched(spark, sf)
    return e.select(
        "id", F.round(features.card_age_years(F.col("date"), F.col("acct_open_date")), 6).alias("card_age_years"),
        features.years_since_pin_change(F.col("date"), F.col("year_pin_last_changed")).alias("years_since_pin_change"))


# ------------------------------------------------------------------------- joins


@query(f"""WITH {TXN}, {CARD}, {USER} SELECT t.id, c.card_brand, c.card_type, c.credit_limit, u.home_state,
  u.yearly_income, coalesce(m.name, 'Unknown') AS category_name
  FROM t LEFT JOIN c ON t.card_id = c.card_id LEFT JOIN u ON t.client_id = u.client_id
  LEFT JOIN (SELECT r_regionkey AS code, r_name AS name FROM region) m ON t.k % 7 = m.code""")
def join_context(spark, sf):
    t = transactions(spark, sf)
    names = read(spark, sf, "region").select(F.col("r_regionkey").alias("mcc"), F.col("r_name").alias("name"))
    joined = left_lookup(left_lookup(t, cards(spark, sf), "card_id"), users(spark, sf), "client_id")
    joined = joined.withColumn("mcc", F.col("k") % 7)
    return left_lookup(joined, names, "mcc").select(
        "id", "card_brand", "card_type", parsing.money(F.col("credit_limit")).alias("credit_limit"), "home_state",
        parsing.money(F.col("yearly_income")).alias("yearly_income"),
        F.coalesce("name", F.lit("Unknown")).alias("category_name"))


@query("""SELECT c_custkey AS card_id, count(*) AS copies FROM (
  SELECT c_custkey FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)
  GROUP BY 1 HAVING count(*) > 1""")
def join_validated(spark, sf):
    """The many-to-one check on a dimension in which every tenth key repeats."""
    c = cards(spark, sf).select("card_id")
    doubled = c.unionByName(c.where(F.col("card_id") % 10 == 0))
    return repeated_keys(doubled, "card_id").withColumnRenamed("count", "copies")


@query("""SELECT l_returnflag AS flag, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT)
  AS cents FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def label_semijoin(spark, sf):
    labelled = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return (
        read(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice")
        .join(labelled, "l_orderkey", "left_semi")
        .groupBy(F.col("l_returnflag").alias("flag"))
        .agg(F.count(F.lit(1)).alias("n"),
             F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))
    )


# ---------------------------------------------------------------------- medians


_MEDIANS = f"""WITH {TXN}, {split_sql()}
  SELECT 'card' AS scope, CAST(card_id AS VARCHAR) AS level, round(median(abs_amount), 6) AS med
  FROM s WHERE split = 'train' GROUP BY card_id
  UNION ALL SELECT 'category', mcc_category, round(median(abs_amount), 6) FROM s WHERE split = 'train' GROUP BY mcc_category
  UNION ALL SELECT 'global', '', round(median(abs_amount), 6) FROM s WHERE split = 'train'"""


@query(_MEDIANS)
def medians_train(spark, sf):
    train = splits.time_split(transactions(spark, sf)).where("split = 'train'")
    fitted = medians.fit(train)
    return (
        fitted.card.select(F.lit("card").alias("scope"), F.col("card_id").cast("string").alias("level"), "med")
        .unionByName(fitted.category.select(F.lit("category").alias("scope"), F.col("mcc_category").alias("level"), "med"))
        .unionByName(fitted.overall.select(F.lit("global").alias("scope"), F.lit("").alias("level"), "med"))
        .withColumn("med", F.round("med", 6))
    )


@query(f"""WITH {TXN}, {split_sql()},
  cm AS (SELECT card_id, median(abs_amount) AS m FROM s WHERE split = 'train' GROUP BY 1),
  mm AS (SELECT mcc_category, median(abs_amount) AS m FROM s WHERE split = 'train' GROUP BY 1),
  g AS (SELECT median(abs_amount) AS m FROM s WHERE split = 'train')
  SELECT id, round(abs_amount / nullif(coalesce(cm.m, g.m), 0), 9) AS amount_vs_card_median,
         round(abs_amount / nullif(coalesce(mm.m, g.m), 0), 9) AS amount_vs_mcc_median
  FROM s CROSS JOIN g LEFT JOIN cm ON s.card_id = cm.card_id LEFT JOIN mm ON s.mcc_category = mm.mcc_category""")
def amount_vs_medians(spark, sf):
    t = splits.time_split(transactions(spark, sf))
    fitted = medians.fit(t.where("split = 'train'"))
    return medians.apply(t, fitted).select(
        "id", F.round("amount_vs_card_median", 9).alias("amount_vs_card_median"),
        F.round("amount_vs_mcc_median", 9).alias("amount_vs_mcc_median"))


# --------------------------------------------------------------------- velocity


def _frame(hours: int) -> str:
    return (f"OVER (PARTITION BY card_id ORDER BY epoch_us(date) RANGE BETWEEN "
            f"{hours * 3_600_000_000} PRECEDING AND 1 PRECEDING)")


_DEC = "CAST(abs_amount AS DECIMAL(18,6))"
_COUNTS = f"""WITH {TXN} SELECT id, count(*) {_frame(1)} AS card_txns_1h, count(*) {_frame(24)} AS card_txns_24h,
  count(*) {_frame(168)} AS card_txns_7d FROM t"""


@query(_COUNTS)
def velocity_counts(spark, sf):
    return add_velocity(transactions(spark, sf)).select("id", "card_txns_1h", "card_txns_24h", "card_txns_7d")


@query(_COUNTS)
def velocity_counts_crowded(spark, sf):
    """The plan for crowded cards, applied to every card: it must agree with the frames."""
    return add_velocity(transactions(spark, sf), force="prefix").select(
        "id", "card_txns_1h", "card_txns_24h", "card_txns_7d")


_SUMS = f"""WITH {TXN} SELECT id, CAST(coalesce(sum({_DEC}) {_frame(24)}, 0) AS DOUBLE) AS card_amount_24h,
  CASE WHEN count(*) {_frame(168)} > 0 THEN round(CAST(sum({_DEC}) {_frame(168)} AS DOUBLE) / count(*) {_frame(168)}, 9)
  END AS card_mean_amount_7d FROM t"""


@query(_SUMS)
def velocity_amounts(spark, sf):
    return add_velocity(transactions(spark, sf)).select(
        "id", "card_amount_24h", F.round("card_mean_amount_7d", 9).alias("card_mean_amount_7d"))


@query(_SUMS)
def velocity_amounts_crowded(spark, sf):
    return add_velocity(transactions(spark, sf), force="prefix").select(
        "id", "card_amount_24h", F.round("card_mean_amount_7d", 9).alias("card_mean_amount_7d"))


_HISTORY = f"""WITH {TXN} SELECT id,
  round((epoch_us(date) - lag(epoch_us(date)) OVER (PARTITION BY card_id ORDER BY date, id)) / 3.6e9, 6)
    AS hours_since_card_txn,
  CASE WHEN row_number() OVER (PARTITION BY card_id, mcc_category ORDER BY date, id) = 1 THEN 1 ELSE 0 END
    AS new_mcc_for_card,
  round(abs_amount / nullif(CAST(sum({_DEC}) {_frame(168)} AS DOUBLE) / nullif(count(*) {_frame(168)}, 0), 0), 9)
    AS amount_vs_card_recent
  FROM t"""


@query(_HISTORY)
def card_history(spark, sf):
    return add_velocity(transactions(spark, sf)).select(
        "id", F.round("hours_since_card_txn", 6).alias("hours_since_card_txn"), "new_mcc_for_card",
        F.round("amount_vs_card_recent", 9).alias("amount_vs_card_recent"))


@query(_HISTORY)
def card_history_crowded(spark, sf):
    return add_velocity(transactions(spark, sf), force="prefix").select(
        "id", F.round("hours_since_card_txn", 6).alias("hours_since_card_txn"), "new_mcc_for_card",
        F.round("amount_vs_card_recent", 9).alias("amount_vs_card_recent"))


def _orders_as_transactions(spark, sf):
    """Orders as transactions: whole-day timestamps, so a card repeats instants."""
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("card_id"),
        F.col("o_orderdate").cast("timestamp").alias("date"),
        F.col("o_totalprice").alias("abs_amount"), F.col("o_orderpriority").alias("mcc_category"))


_TIES = """WITH t AS (SELECT o_orderkey AS id, o_custkey AS card_id, o_orderdate AS date, o_totalprice AS abs_amount,
  o_orderpriority AS mcc_category FROM orders)
  SELECT id, count(*) OVER w AS card_txns_7d,
    round((epoch_us(date) - lag(epoch_us(date)) OVER (PARTITION BY card_id ORDER BY date, id)) / 3.6e9, 6)
      AS hours_since_card_txn,
    CASE WHEN row_number() OVER (PARTITION BY card_id, mcc_category ORDER BY date, id) = 1 THEN 1 ELSE 0 END
      AS new_mcc_for_card
  FROM t WINDOW w AS (PARTITION BY card_id ORDER BY epoch_us(date) RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING)"""


@query(_TIES)
def velocity_ties(spark, sf):
    return add_velocity(_orders_as_transactions(spark, sf)).select(
        "id", "card_txns_7d", F.round("hours_since_card_txn", 6).alias("hours_since_card_txn"), "new_mcc_for_card")


@query(_TIES)
def velocity_ties_crowded(spark, sf):
    return add_velocity(_orders_as_transactions(spark, sf), force="prefix").select(
        "id", "card_txns_7d", F.round("hours_since_card_txn", 6).alias("hours_since_card_txn"), "new_mcc_for_card")


_ODD = """WITH t AS (SELECT event_id - event_id % 3 AS id, CASE WHEN user_id % 5 > 0 THEN user_id END AS card_id,
  date_trunc('hour', ts) AS date, abs(value) AS abs_amount, event_type AS mcc_category FROM events),
  u AS (SELECT *, min(id) OVER (PARTITION BY card_id, date) AS lead_id, max(epoch_us(date)) OVER w AS before_us,
    min(struct_pack(u := epoch_us(date), i := id)) OVER (PARTITION BY card_id, mcc_category) AS first_use,
    count(*) OVER w7 AS card_txns_7d, CAST(coalesce(sum(CAST(abs_amount AS DECIMAL(18,6))) OVER w1, 0) AS DOUBLE) AS card_amount_24h
    FROM t WINDOW w AS (PARTITION BY card_id ORDER BY epoch_us(date) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    w1 AS (PARTITION BY card_id ORDER BY epoch_us(date) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING),
    w7 AS (PARTITION BY card_id ORDER BY epoch_us(date) RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING))
  SELECT plan, id, card_id, mcc_category, card_txns_7d, card_amount_24h,
    round(CASE WHEN id = lead_id THEN (epoch_us(date) - before_us) / 3.6e9 ELSE 0 END, 6) AS hours_since_card_txn,
    CASE WHEN first_use.u = epoch_us(date) AND first_use.i = id THEN 1 ELSE 0 END AS new_mcc_for_card
  FROM u, (VALUES ('frames'), ('prefix'), ('mixed')) p(plan)"""


@query(_ODD)
def velocity_edge_cases(spark, sf):
    """Missing cards, ids on several rows and cards, equal instants: all plans must give the same rows."""
    e = read(spark, sf, "events")
    odd = e.select((F.col("event_id") - F.col("event_id") % 3).alias("id"), F.when(F.col("user_id") % 5 > 0, F.col("user_id")).alias("card_id"),
                   F.date_trunc("hour", "ts").cast("timestamp").alias("date"), F.abs("value").alias("abs_amount"), F.col("event_type").alias("mcc_category"))
    plans = {"frames": {"force": "frames"}, "prefix": {"force": "prefix"}, "mixed": {"crowded": 20}}
    made = [add_velocity(odd, **kw).select(F.lit(plan).alias("plan"), "id", "card_id", "mcc_category", "card_txns_7d", "card_amount_24h",
                                           F.round("hours_since_card_txn", 6).alias("hours_since_card_txn"), "new_mcc_for_card")
            for plan, kw in plans.items()]
    return made[0].unionByName(made[1]).unionByName(made[2])


# --------------------------------------------------------------- splits and samples


@query(f"WITH {TXN}, {split_sql()} SELECT id, split FROM s")
def time_split(spark, sf):
    return splits.time_split(transactions(spark, sf)).select("id", "split")


_VAL = """v AS (SELECT *, row_number() OVER (ORDER BY date, id) - 1 AS vr, count(*) OVER () AS vn FROM s WHERE split = 'val'),
  p AS (SELECT id, date, card_id, mcc_category, abs_amount, is_fraud, score, score_b, k,
               CASE WHEN vr < floor(vn * CAST(0.6 AS DOUBLE)) THEN 'val_fit' ELSE 'val_sel' END AS split FROM v
        UNION ALL SELECT id, date, card_id, mcc_category, abs_amount, is_fraud, score, score_b, k, split
        FROM s WHERE split <> 'val')"""


@query(f"WITH {TXN}, {split_sql()}, {_VAL} SELECT id, split FROM p")
def val_cut(spark, sf):
    return splits.val_cut(splits.time_split(transactions(spark, sf))).select("id", "split")


@query(f"""WITH {TXN}, {split_sql()} SELECT split, count(*) AS rows, CAST(sum(is_fraud) AS BIGINT) AS fraud,
  round(avg(is_fraud), 8) AS fraud_rate, strftime(min(date), '%Y-%m-%d %H:%M:%S') AS "start",
  strftime(max(date), '%Y-%m-%d %H:%M:%S') AS "end" FROM s GROUP BY split""")
def split_summary(spark, sf):
    s = splits.split_summary(splits.time_split(transactions(spark, sf)))
    text = lambda c: F.date_format(c, parsing.DATE_FORMAT).alias(c)
    return s.select("split", "rows", "fraud", F.round("fraud_rate", 8).alias("fraud_rate"), text("start"), text("end"))


@query(f"""WITH {TXN}, {split_sql()},
  i AS (SELECT id, count(*) AS n, min(split) AS a, max(split) AS b FROM s GROUP BY id)
  SELECT CAST(sum(CAST(a <> b AS INTEGER)) AS BIGINT) AS shared_ids,
         CAST(sum(CAST(n > 1 AS INTEGER)) AS BIGINT) AS repeated_ids,
         CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_ids,
         (SELECT CAST(max(date) FILTER (split = 'train') > min(date) FILTER (split = 'val') AS INTEGER)
               + CAST(max(date) FILTER (split = 'val') > min(date) FILTER (split = 'test') AS INTEGER) FROM s)
           AS backward_boundaries FROM i""")
def leakage_check(spark, sf):
    return splits.leakage_report(splits.time_split(transactions(spark, sf)))


@query("""WITH a AS (SELECT l_orderkey AS id, CASE WHEN l_returnflag = 'N' THEN 'test'
  WHEN l_returnflag = 'R' THEN 'train' ELSE 'val' END AS split FROM lineitem),
  d AS (SELECT DISTINCT id, split FROM a)
  SELECT x.split AS left_split, y.split AS right_split, count(*) AS shared_ids
  FROM d x JOIN d y ON x.id = y.id AND x.split < y.split GROUP BY 1, 2""")
def split_overlap(spark, sf):
    """Pairwise id overlap on a deliberately leaking assignment: order keys by return flag."""
    li = read(spark, sf, "lineitem")
    side = F.when(F.col("l_returnflag") == "N", "test").when(F.col("l_returnflag") == "R", "train").otherwise("val")
    return splits.split_overlap(li.select(F.col("l_orderkey").alias("id"), side.alias("split")))


def _negatives(count: str) -> str:
    return f"""WITH {TXN}, h AS (SELECT id, is_fraud,
    row_number() OVER (PARTITION BY is_fraud ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) AS rn,
    count(*) OVER (PARTITION BY is_fraud) AS cn FROM t)
  SELECT id, is_fraud FROM h WHERE is_fraud = 1 OR rn <= {count}"""


@query(_negatives("greatest(round_even(cn * CAST(0.1 AS DOUBLE), 0), 1)"))
def subsample_negatives(spark, sf):
    return splits.subsample(transactions(spark, sf), 0.1).select("id", "is_fraud")


@query(_negatives("floor(cn * CAST(0.25 AS DOUBLE))"))
def thin_negatives(spark, sf):
    return splits.thin_negatives(transactions(spark, sf), 0.25).select("id", "is_fraud")


@query(f"""WITH {TXN} SELECT id, is_fraud FROM t WHERE is_fraud = 1
  ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id LIMIT 1""")
def random_fraud_draw(spark, sf):
    return splits.draw_one(transactions(spark, sf), F.col("is_fraud") == 1).select("id", "is_fraud")


@query(f"""WITH {TXN} SELECT count(DISTINCT card_id) AS cards, count(DISTINCT mcc_category) AS categories,
  count(*) AS rows, CAST(sum(is_fraud) AS BIGINT) AS frauds, round(avg(is_fraud), 8) AS fraud_rate FROM t""")
def distinct_counts(spark, sf):
    """Distinct counts by grouping first, so one large group never sits in one set."""
    t = transactions(spark, sf)
    n = lambda c: t.groupBy(c).agg(F.lit(1).alias("x")).where(F.col(c).isNotNull()).agg(F.count("x")).scalar()
    return t.agg(F.count(F.lit(1)).alias("rows"), F.sum("is_fraud").cast("bigint").alias("frauds"),
                 F.round(F.avg("is_fraud"), 8).alias("fraud_rate")).withColumns(
        {"cards": n("card_id"), "categories": n("mcc_category")})


@query(f"""WITH {ENRICHED}, l AS (SELECT 'use_chip' AS "column", use_chip AS level FROM e
  UNION ALL SELECT 'mcc_category', mcc_category FROM e UNION ALL SELECT 'card_brand', card_brand FROM e
  UNION ALL SELECT 'card_type', card_type FROM e UNION ALL SELECT 'error_kind', error_kind FROM e)
  SELECT "column", level, CAST(row_number() OVER (PARTITION BY "column" ORDER BY level) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT "column", level FROM l WHERE level IS NOT NULL)""")
def distinct_levels(spark, sf):
    return context.learn_levels(enriched(spark, sf))


@query(f"""WITH {TXN}, {split_sql()}, k AS (SELECT DISTINCT mcc_category FROM s WHERE split = 'train' AND mcc_category <> 'signup')
  SELECT s.id, k.mcc_category AS mcc_category, coalesce(k.mcc_category, '__missing__') AS filled
  FROM s LEFT JOIN k ON s.mcc_category = k.mcc_category WHERE split <> 'train'""")
def align_levels(spark, sf):
    """Levels never seen in training become NULL (here one level is withheld to show it)."""
    s = splits.time_split(transactions(spark, sf))
    trained = context.learn_levels(s.where("split = 'train' and mcc_category <> 'signup'"), ["mcc_category"])
    aligned = context.align_levels(s.where("split <> 'train'"), trained, ["mcc_category"])
    return aligned.select("id", "mcc_category", F.coalesce("mcc_category", F.lit("__missing__")).alias("filled"))
