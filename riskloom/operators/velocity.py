"""Trailing per-card behaviour: what the card did just before each transaction.

Windows are ``[t - w, t)``: the current row, and every row at the same instant, is outside.

Two plans give identical results and are chosen per card by row count:

* **frames** - one exchange on the card, then RANGE frames. A sliding frame costs rows times
  frame length, so it is kept for cards with at most ``crowded`` rows.
* **prefix sums** - for crowded cards. Rows of one card at one instant see the same windows, so
  they are merged to one tick first, map-side. The timeline of a card is cut into granules, and each
  (card, granule) is its own task key. A window is the whole granules in it, by running totals over
  granules, and parts of the two at its ends, by running totals over their ticks: a tick sends a
  probe to the granule in which a window starts, if that one holds rows. Work is linear, a card
  spreads over as many tasks as it has granules, and a granule holds no more ticks than the clock
  has instants in it.

Amounts are added as decimals, so totals do not depend on row order or plan. What a row gets depends on
values only: of rows at one instant, those with the least id look back to the instant before and
the others see this one; the first use of a category is at the least (instant, id), on every row that has
it. A missing card is a card of its own, and an id may occur on several rows and cards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.features import clock, safe_ratio
from riskloom.operators.skew import crowded_keys, inner_lookup, is_small
from riskloom.sources.shared import materialize

HOUR_US = 3_600_000_000
SPANS = {"1h": HOUR_US, "24h": 24 * HOUR_US, "7d": 7 * 24 * HOUR_US}
MONEY = "decimal(18,6)"
RAW = [f"_n_{s}" for s in SPANS] + ["_amt_24h", "_amt_7d", "_prev_us", "_first_mcc"]


def add_velocity(df: DataFrame, card: str = "card_id", ts: str = "date", key: str = "id",
                 amount: str = "abs_amount", category: str = "mcc_category",
                 crowded: int = 10_000, granule_us: int = HOUR_US,
                 force: str | None = None) -> DataFrame:
    """Add the eight velocity columns. ``force`` pins one plan ('frames' or 'prefix')."""
    rows = df.withColumn("_us", clock(F.col(ts))).withColumn("_amt", F.col(amount).cast(MONEY))
    if force == "frames":
        raw = _frames(rows, card, key, category)
    elif force == "prefix":
        raw = _prefix(rows, card, key, category, granule_us)
    else:
        rows = materialize(rows)  # read by the count and by both plans
        busy = materialize(crowded_keys(rows, card, crowded).withColumnRenamed(card, "_busy"))
        if busy.isEmpty():
            raw = _frames(rows, card, key, category)
        else:
            if is_small(busy):
                busy = F.broadcast(busy)
            same = rows[card].eqNullSafe(busy["_busy"])
            raw = _frames(rows.join(busy, same, "left_anti"), card, key, category).unionByName(
                _prefix(rows.join(busy, same, "left_semi"), card, key, category, granule_us))
    return _finish(raw, df.columns, amount)


def _finish(raw: DataFrame, keep: list[str], amount: str) -> DataFrame:
    mean = F.col("_amt_7d").cast("double") / F.nullif(F.col("_n_7d"), F.lit(0))
    return (
        raw.withColumn("card_mean_amount_7d", mean)
        .select(
            *keep,
            *[F.col(f"_n_{s}").cast("bigint").alias(f"card_txns_{s}") for s in SPANS],
            F.col("_amt_24h").cast("double").alias("card_amount_24h"),
            "card_mean_amount_7d",
            ((F.col("_us") - F.col("_prev_us")) / F.lit(float(HOUR_US))).alias("hours_since_card_txn"),
            safe_ratio(F.col(amount), F.col("card_mean_amount_7d")).alias("amount_vs_card_recent"),
            F.col("_first_mcc").cast("int").alias("new_mcc_for_card"),
        )
    )


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _frames(rows: DataFrame, card: str, key: str, category: str) -> DataFrame:
    # (card, category) and (card, instant) are clustered already once rows are clustered by card: one exchange.
    instant = Window.partitionBy(card, "_us")
    before = Window.partitionBy(card).orderBy("_us").rangeBetween(Window.unboundedPreceding, -1)
    trail = {s: Window.partitionBy(card).orderBy("_us").rangeBetween(-w, -1) for s, w in SPANS.items()}
    use = F.struct("_us", key)
    leads = F.col(key).eqNullSafe(F.min(key).over(instant))
    return (
        rows.withColumn("_first_mcc", use == F.min(use).over(Window.partitionBy(card, category)))
        .withColumn("_prev_us", F.when(leads, F.max("_us").over(before)).otherwise(F.col("_us")))
        .select(
            *rows.columns, "_first_mcc", "_prev_us",
            *[F.count(F.lit(1)).over(trail[s]).alias(f"_n_{s}") for s in SPANS],
            _zero(F.sum("_amt").over(trail["24h"])).alias("_amt_24h"),
            _zero(F.sum("_amt").over(trail["7d"])).alias("_amt_7d"),
        )
    )


def _prefix(rows: DataFrame, card: str, key: str, category: str, granule_us: int) -> DataFrame:
    if any(w % granule_us for w in SPANS.values()):
        raise ValueError("the granule must divide every window")
    plain, given, card = rows.columns, card, "_card"
    rows = rows.withColumn(card, F.struct(given))  # a struct is never NULL itself, so a missing card joins like any other
    offset = F.pmod(F.col("_us"), F.lit(granule_us))
    granule = F.expr(f"(_us - pmod(_us, {granule_us})) div {granule_us}")
    backs = {s: w // granule_us for s, w in SPANS.items()}
    ticks = rows.groupBy(card, "_us").agg(
        F.count(F.lit(1)).alias("_tn"), F.sum("_amt").alias("_tm"), F.min(key).alias("_lead"))
    # Granules with rows: what lies in the whole granules of each window, and whether a window starts in one with rows.
    sums = rows.groupBy(card, granule.alias("_g")).agg(
        F.count(F.lit(1)).alias("_gn"), F.sum("_amt").alias("_gm"), F.max("_us").alias("_gl"))
    along = Window.partitionBy(card).orderBy("_g")
    upto = lambda c, g: _zero(F.sum(c).over(along.rangeBetween(Window.unboundedPreceding, g)))
    granules = sums.select(
        card, "_g", F.max("_gl").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_last"),
        *[(upto("_gn", -1) - upto("_gn", -b - 1)).alias(f"_whole_n_{s}") for s, b in backs.items()],
        *[(upto("_gm", -1) - upto("_gm", -backs[s] - 1)).alias(f"_whole_amt_{s}") for s in ("24h", "7d")],
        *[(F.count(F.lit(1)).over(along.rangeBetween(-b, -b)) > 0).alias(f"_at_{s}") for s, b in backs.items()],
    )
    # A tick stands in its own granule and asks each granule with rows in which one of its windows starts.
    marks = F.array(F.struct(F.lit("now").alias("tag"), F.lit(0).cast("bigint").alias("back"), F.lit(True).alias("there")),
                    *[F.struct(F.lit(s).alias("tag"), F.lit(b).cast("bigint").alias("back"), F.col(f"_at_{s}").alias("there"))
                      for s, b in backs.items()])
    own = F.col("m.tag") == "now"
    whole = [f"_whole_{c}" for c in ("n_1h", "n_24h", "n_7d", "amt_24h", "amt_7d")]
    probes = (
        ticks.select("*", offset.alias("_off"), granule.alias("_g")).join(granules, [card, "_g"])
        .select("*", F.explode(F.filter(marks, lambda m: m["there"])).alias("m"))
        .select(card, "_us", "_off", F.col("m.tag").alias("_tag"), (F.col("_g") - F.col("m.back")).alias("_g"),
                *[F.when(own, F.col(c)).alias(c) for c in ("_tn", "_tm", "_lead", "_last", *whole)])
    )
    earlier = Window.partitionBy(card, "_g").orderBy("_off").rangeBetween(Window.unboundedPreceding, -1)
    now = F.col("_tag") == "now"
    totals = probes.select(
        card, "_us", "_tag", "_tn", "_lead", *whole,
        F.when(now, F.coalesce(F.max(F.when(now, F.col("_us"))).over(earlier), F.col("_last"))).alias("_prev"),
        _zero(F.sum("_tn").over(earlier)).alias("_ahead_n"), _zero(F.sum("_tm").over(earlier)).alias("_ahead_amt"),
    )
    # A window: its whole granules and what its last granule holds before the tick, less what its first granule holds before its start.
    held = lambda c, s: F.sum(F.when(now, F.col(f"_whole_{c}_{s}") + F.col(f"_ahead_{c}"))
                              .when(F.col("_tag") == s, -F.col(f"_ahead_{c}"))).alias(f"_{c}_{s}")
    windows = totals.groupBy(card, "_us").agg(
        *[held("n", s) for s in SPANS], *[held("amt", s) for s in ("24h", "7d")],
        F.max("_prev").alias("_before"), F.max("_lead").alias("_lead"))
    wide = inner_lookup(rows, windows, [card, "_us"]).withColumn(
        "_prev_us", F.when(F.col(key).eqNullSafe(F.col("_lead")), F.col("_before")).otherwise(F.col("_us")))
    # The first use of a (card, category) pair by a plain minimum: combined map-side, so a pair
    # that covers most of the table is still one row per task after the partial aggregation.
    firsts = (
        rows.groupBy(card, category).agg(F.min(F.struct("_us", key)).alias("f"))
        .select(F.struct(F.col(card), F.col(category), F.col("f._us").alias("_us"), F.col(f"f.{key}").alias(key)).alias("_use"),
                F.lit(True).alias("_is_first"))
    )
    return (
        wide.withColumn("_use", F.struct(F.col(card), F.col(category), F.col("_us"), F.col(key))).join(firsts, "_use", "left")
        .withColumn("_first_mcc", F.coalesce("_is_first", F.lit(False)))
        .select(*plain, *RAW)
    )
