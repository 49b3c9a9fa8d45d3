from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import splits
from riskloom.operators.skew import inner_lookup
from riskloom.operators.velocity import HOUR_US, add_velocity
from riskloom.schema import VELOCITY
from riskloom.sources.shared import written

BASE = datetime(2020, 3, 1)
SCHEMA = "id bigint, card_id int, date timestamp, abs_amount double, mcc_category string"


def busy_rows(n=240, seed=3):
    """One card holds most rows; instants repeat and windows straddle granule borders."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        card = 1 if rng.random() < 0.7 else int(rng.integers(2, 6))
        minutes = int(rng.integers(0, 14 * 24 * 6)) * 10
        rows.append((i, card, BASE + timedelta(minutes=minutes), float(np.round(rng.random() * 90, 2)), "abc"[int(rng.integers(0, 3))]))
    rows.append((n, 1, BASE, 10.0, "a"))
    rows.append((n + 1, 1, BASE + timedelta(hours=1), 5.0, "a"))  # exactly at a window's lower edge
    return rows


def brute(rows):
    out = {}
    for i, card, t, amount, cat in rows:
        mine = [r for r in rows if r[1] == card]
        inside = lambda h: [r for r in mine if t - timedelta(hours=h) <= r[2] < t]
        before = [r for r in mine if (r[2], r[0]) < (t, i)]
        week = inside(168)
        mean = sum(r[3] for r in week) / len(week) if week else None
        out[i] = {
            "card_txns_1h": len(inside(1)), "card_txns_24h": len(inside(24)), "card_txns_7d": len(week),
            "card_amount_24h": sum(r[3] for r in inside(24)), "card_mean_amount_7d": mean,
            "hours_since_card_txn": (t - max(r[2] for r in before)).total_seconds() / 3600 if before else None,
            "amount_vs_card_recent": amount / mean if mean else None,
            "new_mcc_for_card": int(not [r for r in before if r[4] == cat]),
        }
    return out


@pytest.mark.parametrize("how", [
    {"force": "frames"}, {"force": "prefix"}, {"force": "prefix", "granule_us": HOUR_US // 4}, {"crowded": 60}])
def test_velocity_against_brute_force(spark, how):
    rows = busy_rows()
    got = {r["id"]: r for r in add_velocity(spark.createDataFrame(rows, SCHEMA), **how).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, expect in want.items():
        for c in VELOCITY:
            assert got[i][c] == (pytest.approx(expect[c]) if expect[c] is not None else None), (i, c)


def test_granule_must_divide_windows(spark):
    with pytest.raises(ValueError):
        add_velocity(spark.createDataFrame(busy_rows(5), SCHEMA), force="prefix", granule_us=7 * HOUR_US)


def sent(plan) -> int:
    """Rows that the exchanges of an executed plan wrote, those of adaptive stages included."""
    name, rows = plan.nodeName(), 0
    if name == "AdaptiveSparkPlan":
        return sent(plan.executedPlan())
    if "QueryStage" in name:
        return sent(plan.plan())
    if name == "Exchange":
        rows = plan.metrics().apply("shuffleRecordsWritten").value()
    below = plan.children()
    return rows + sum(sent(below.apply(k)) for k in range(below.size()))


def test_a_tick_asks_only_granules_with_rows(spark):
    """Rows days apart: no window starts in a granule with rows, so a tick travels alone, and no table is written for the lookup."""
    rows = [(i, i % 4, BASE + timedelta(hours=25 * (i // 4), minutes=i), float(i), "a") for i in range(120)]
    tables = written()
    out = add_velocity(spark.createDataFrame(rows, SCHEMA), force="prefix").select("id", "hours_since_card_txn", "card_txns_7d")
    plan = out._jdf.queryExecution().executedPlan()
    got = {r["id"]: r["card_txns_7d"] for r in map(lambda r: {"id": r.getLong(0), "card_txns_7d": r.getLong(2)}, plan.executeCollectPublic())}
    assert got == {r[0]: brute(rows)[r[0]]["card_txns_7d"] for r in rows}
    assert written() == tables
    assert sent(plan) < 10 * len(rows)


def test_inner_lookup_of_hot_keys(spark):
    facts = spark.createDataFrame([(k % 3 if k < 30 else k, k) for k in range(40)], "k int, fact int")
    lookup = spark.createDataFrame([(k, k * 10) for k in range(36)], "k int, value int")
    want = sorted(map(tuple, facts.join(lookup, "k").collect()))
    for hot_rows in (3, 100):
        assert sorted(map(tuple, inner_lookup(facts, lookup, ["k"], hot_rows).collect())) == want


def hourly(spark, n=1000):
    return spark.range(n).select(
        "id", F.timestamp_seconds(F.lit(1_577_836_800) + F.col("id") * 3600).alias("date"),
        (F.col("id") % 10 == 0).cast("int").alias("is_fraud"))


def test_time_split_sizes_and_order(spark):
    out = splits.time_split(hourly(spark))
    n = {r["split"]: r["rows"] for r in splits.split_summary(out).collect()}
    assert n == {"train": 820, "val": 80, "test": 90, "demo": 10}
    splits.assert_no_leakage(out)
    cut = splits.val_cut(out).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in cut}["val_fit"] == 48


def test_tiny_split(spark):
    out = splits.time_split(hourly(spark, 3))
    assert sorted(r["split"] for r in out.collect()) == ["demo", "train", "train"]


def assigned(spark, rows):
    return spark.createDataFrame(
        [(i, BASE + timedelta(days=d), 0, s) for i, d, s in rows], "id bigint, date timestamp, is_fraud int, split string")


def test_leakage_guards_raise(spark):
    clean = [(1, 0, "train"), (2, 1, "val"), (3, 2, "test"), (4, 3, "demo")]
    splits.assert_no_leakage(assigned(spark, clean))
    with pytest.raises(splits.Leakage):
        splits.assert_no_leakage(assigned(spark, clean + [(1, 2, "test")]))
    with pytest.raises(splits.Leakage):
        splits.assert_no_leakage(assigned(spark, clean + [(4, 3, "demo")]))
    with pytest.raises(splits.Leakage):
        splits.assert_no_leakage(assigned(spark, clean + [(9, 5, "train")]))


def test_subsample_keeps_every_positive(spark):
    df = hourly(spark)
    out = splits.subsample(df, 0.1)
    n = {r["is_fraud"]: r["count"] for r in out.groupBy("is_fraud").count().collect()}
    assert n == {1: 100, 0: 90}
    both = splits.subsample(df, 0.001, keep_all_positives=False)
    assert both.groupBy("is_fraud").count().where("count = 1").count() == 2
    thin = {r["is_fraud"]: r["count"] for r in splits.thin_negatives(df, 0.5).groupBy("is_fraud").count().collect()}
    assert thin == {1: 100, 0: 450}
    assert splits.draw_one(df, F.col("is_fraud") == 1).first()["is_fraud"] == 1
