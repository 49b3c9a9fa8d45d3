import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import ordering
from riskloom.operators.skew import DuplicateKey, check_unique, dominant_keys, left_lookup

RNG = np.random.default_rng(7)


def frame(spark, values, groups=None):
    groups = groups if groups is not None else ["g"] * len(values)
    return spark.createDataFrame([(g, float(v)) for g, v in zip(groups, values)], "g string, v double")


@pytest.mark.parametrize("values", [
    RNG.normal(0, 1e3, 400), np.repeat([0.0, 1.5, 1.5, -2.0], 50), RNG.random(300) * 1e-12,
    np.r_[np.zeros(200), RNG.random(100)], [5.0], 1 - RNG.random(300) * 1e-9,
])
def test_quantiles_equal_numpy(spark, values):
    probs = [0.0, 0.025, 0.1, 0.5, 0.77, 0.998, 1.0]
    got = ordering.quantile_list(frame(spark, values), "v", probs)
    assert got == pytest.approx(list(np.quantile(np.asarray(values, float), probs)), rel=1e-12, abs=1e-300)


def test_quantiles_per_group_with_one_dominant_group(spark):
    values = np.r_[RNG.random(900), RNG.random(30) * 100, [7.0]]
    groups = ["hot"] * 900 + ["cold"] * 30 + ["single"]
    rows = ordering.exact_quantiles(frame(spark, values, groups), "v", [0.25, 0.5], ["g"]).collect()
    got = {(r["g"], r["q"]): r["value"] for r in rows}
    for g in set(groups):
        own = values[np.array(groups) == g]
        for q in (0.25, 0.5):
            assert got[g, q] == pytest.approx(np.quantile(own, q))


def test_quantiles_skip_missing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (3.0,)], "v double")
    assert ordering.quantile_list(df, "v", [0.5]) == [2.0]


def test_order_key_is_monotone(spark):
    values = np.sort(np.r_[RNG.normal(0, 1, 500), [0.0, 1e-300, -1e-300, 1e300, -1e300, 5e-324], np.nextafter(1, 2), 1.0])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    keys = [r[0] for r in df.orderBy("i").select(ordering.order_key(F.col("v"))).collect()]
    assert keys == sorted(keys)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    values = np.unique(np.round(RNG.normal(0, 5, 300), 2))
    df = spark.createDataFrame([(float(v), int(i % 7)) for i, v in enumerate(values)], "v double, n int")
    rows = ordering.running_totals(df, "v", ["n"], descending=descending).collect()
    ordered = sorted(rows, key=lambda r: -r["v"] if descending else r["v"])
    assert [r["cum_n"] for r in ordered] == list(np.cumsum([r["n"] for r in ordered]))


@pytest.mark.parametrize("small", [1, 5, 10_000])
def test_rank_cuts_descend_through_ties(spark, small):
    # A third of all rows share one instant, so the descent has to go on into the key digits.
    us = np.r_[RNG.integers(0, 3 * 86_400_000_000, 200), np.full(100, 86_400_000_123)]
    ids = RNG.permutation(len(us)) * 70_000
    df = spark.createDataFrame([(int(u), int(i)) for u, i in zip(us, ids)], "u bigint, k bigint")
    want = sorted(zip(us.tolist(), ids.tolist()))
    ranks = [0, 17, 100, 150, 199, 299]
    assert ordering.rank_cuts(df, F.col("u"), F.col("k"), ranks, small=small) == [want[r] for r in ranks]


def test_lowest_by_hash_is_exact_and_repeatable(spark):
    df = spark.range(1000)
    a = {r["id"] for r in ordering.lowest_by_hash(df, "id", 137, 1).collect()}
    b = {r["id"] for r in ordering.lowest_by_hash(df.repartition(7), "id", 137, 1).collect()}
    assert len(a) == 137 and a == b
    assert a != {r["id"] for r in ordering.lowest_by_hash(df, "id", 137, 2).collect()}
    assert ordering.lowest_by_hash(df, "id", 0, 1).count() == 0
    assert ordering.lowest_by_hash(df, "id", 5000, 1).count() == 1000


def test_open_slots_reach_the_scan_as_ranges_of_the_timestamp(spark, tmp_path):
    rows = spark.range(5000).select("id", F.timestamp_micros(F.col("id") % 40 * 43_200_000_000 + F.col("id") % 3 * 1_500_000 - 86_400_000_000 * 7).alias("date"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    want = sorted((r.u, r.id) for r in rows.select(F.unix_micros("date").alias("u"), "id").collect())
    ranks = [0, 1, 2499, 4100, 4999]
    for small in (1, 50, 10_000):
        assert ordering.rank_cuts(rows, F.unix_micros("date"), F.col("id"), ranks, small, F.col("date")) == [want[r] for r in ranks]
    base = rows.select(F.unix_micros("date").alias("_t"), F.col("id").alias("_k"), F.col("date").alias("_i"))
    digits = [F.floor(F.col("_t") / F.lit(86_400_000_000)).cast("bigint")]
    some = ordering._in_paths(base, digits, {(-3,), (4,)})
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan.split("PushedFilters")[1] and "LessThan(date" in plan.split("PushedFilters")[1]
    assert {r._t // 86_400_000_000 for r in some.collect()} == {-3, 4}


def test_left_lookup_plans_agree(spark):
    keys = [1] * 500 + [2] * 20 + [None] * 5 + list(range(3, 40)) + [99]
    facts = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k int")
    dim = spark.createDataFrame([(k, f"n{k}") for k in range(1, 40)], "k int, name string")
    want = {(i, f"n{k}" if k is not None and k < 40 else None) for i, k in enumerate(keys)}
    for small, salts in ((1000, 4), (0, 4), (0, 1)):
        got = left_lookup(facts, dim, "k", small=small, salts=salts)
        assert {(r["i"], r["name"]) for r in got.collect()} == want
    assert dominant_keys(facts, "k", 10) == [1, 2] or set(dominant_keys(facts, "k", 10)) == {1, 2}


def test_chained_lookups_scan_the_facts_once(spark, tmp_path):
    spark.range(50).selectExpr("id", "id % 3 AS a", "id % 5 AS b", "id % 7 AS c").write.parquet(str(tmp_path / "facts"))
    out = spark.read.parquet(str(tmp_path / "facts"))
    for k in "abc":
        out = left_lookup(out, spark.range(10).selectExpr(f"id AS {k}", f"id * 2 AS {k}2"), k, small=0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert {(r.a2, r.b2, r.c2) for r in out.collect()} == {(2 * (i % 3), 2 * (i % 5), 2 * (i % 7)) for i in range(50)}


def test_duplicate_dimension_key_is_refused(spark):
    check_unique(spark.range(5), "id")
    with pytest.raises(DuplicateKey):
        check_unique(spark.range(5).union(spark.range(1)), "id")


def test_lookup_deals_a_hot_key_over_tasks_without_copies_of_the_table(spark, tmp_path):
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k, None) for k in conf}
    hot = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id") % 5000).cast("long")  # a third, and a third without a key
    facts = spark.range(0, 120_000, 1, 48).withColumn("k", hot).withColumn("pad", F.sha2(F.col("id").cast("string"), 256))
    dim = spark.range(6000).selectExpr("id AS k", "id * 2 AS v")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = left_lookup(facts, dim, "k", small=0)
        assert out.where("NOT (v <=> k * 2)").count() == 0
        out.withColumn("p", F.spark_partition_id()).write.parquet(str(tmp_path / "placed"))
        places = spark.read.parquet(str(tmp_path / "placed")).select("k", "p").distinct().collect()
        assert len({r.p for r in places if r.k == 7}) > 16 and len({r.p for r in places if r.k is None}) > 16
        assert "explode" not in left_lookup(facts, dim, "k", small=0)._jdf.queryExecution().toString()
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
        off = left_lookup(facts, dim, "k", small=0)
        assert "_salt" in off._jdf.queryExecution().toString() and off.where("NOT (v <=> k * 2)").count() == 0 and off.count() == 120_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
