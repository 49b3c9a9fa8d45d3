import json
import os

import pytest
from pyspark.sql import functions as F

from riskloom.operators import context, decisions, requests, review
from riskloom.operators.decisions import OperatingPoint
from riskloom.plans import review_log, scoring
from riskloom.schema import CATEGORICAL, FEATURES, REVIEW_EVENT
from riskloom.sources import readers, sinks
from riskloom.sources.shared import materialize, release, scope, scratch, shared_dir
from riskloom.streaming import scoring as streams

LEVELS = {"use_chip": ["Chip Transaction", "Online Transaction"], "mcc_category": ["Eating Places"],
          "card_brand": ["Visa"], "card_type": ["Debit"], "error_kind": ["Bad PIN", "none"]}


def dictionaries(spark):
    names = spark.createDataFrame([(5812, "Eating Places")], "mcc int, name string")
    med = spark.createDataFrame([("Eating Places", 50.0)], "mcc_category string, med double")
    return requests.Dictionaries(names, med, 40.0, LEVELS)


def ask(spark, *bodies):
    text = [(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return requests.parse_json(spark.createDataFrame(text, "i int, body string"))


def features_of(spark, *bodies):
    out = requests.featurize(ask(spark, *bodies), dictionaries(spark))
    return out.orderBy("i").collect()


FULL = {"amount": 142.5, "date": "2019-06-14T02:31:00", "use_chip": "Chip Transaction", "mcc": 5812, "credit_limit": 12000,
        "card_brand": "Visa", "card_type": "Debit", "has_chip": True, "zip": None, "errors": None}


def test_full_request(spark):
    (r,) = features_of(spark, FULL)
    assert r["missing_fields"] == [] and r["reject_reason"] is None
    assert (r["hour"], r["is_night"], r["is_online"], r["has_chip"], r["has_error"]) == (2.0, 1.0, 1.0, 1.0, 0.0)
    assert r["amount_to_credit_limit"] == pytest.approx(142.5 / 12000)
    assert r["amount_vs_mcc_median"] == pytest.approx(142.5 / 50)
    assert r["mcc_category"] == "Eating Places" and r["error_kind"] == "none"


def test_sparse_request_reports_gaps_and_invents_nothing(spark):
    (r,) = features_of(spark, {"amount": -20})
    assert r["missing_fields"] == sorted(["card_brand", "card_type", "credit_limit", "date", "mcc", "mcc_category", "use_chip"])
    for c in ("hour", "is_night", "has_chip", "amount_to_credit_limit", "use_chip", "mcc_category"):
        assert r[c] is None
    assert r["abs_amount"] == 20.0 and r["amount_vs_mcc_median"] == 0.5


def test_awkward_values(spark):
    rows = features_of(
        spark,
        {**FULL, "use_chip": "Telepathy", "errors": " Bad PIN ,x", "zip": 0},
        {**FULL, "is_online": False, "date": "not a date", "credit_limit": 0},
        {**FULL, "date": "2019-06-14", "zip": 90210, "mcc": 1},
        {**FULL, "date": "2019-06-14T23:10:00+02:00", "has_chip": False})
    assert rows[0]["use_chip"] is None and rows[0]["error_kind"] == "Bad PIN" and rows[0]["is_online"] == 1.0
    assert rows[0]["missing_fields"] == []  # unseen is not the same as missing
    assert rows[1]["is_online"] == 0.0 and rows[1]["hour"] is None and rows[1]["amount_to_credit_limit"] is None
    assert rows[1]["missing_fields"] == ["credit_limit", "date"]
    assert rows[2]["hour"] == 0.0 and rows[2]["is_online"] == 0.0 and rows[2]["missing_fields"] == ["mcc", "mcc_category"]
    assert rows[3]["hour"] == 23.0 and rows[3]["has_chip"] == 0.0


@pytest.mark.parametrize("bad", [{}, {"amount": "abc"}, {"amount": None}, '{"amount": "Infinity"}', {"amount": 1e12},
                                 {"amount": 1, "mcc": "not-a-code"}, {"amount": 1, "mcc": 12.5}, "{oops", "[]"])
def test_bad_requests_are_named(spark, bad):
    assert ask(spark, bad).first()["reject_reason"]


def test_rebuilt_request(spark):
    row = spark.createDataFrame(
        [(1, 50.0, None, None, None, "Eating Places", None, "Debit", "none", 1, "2019-06-14 02:31:00", 1)],
        "id int, abs_amount double, amount_to_credit_limit double, has_chip int, use_chip string, mcc_category string, "
        "card_brand string, card_type string, error_kind string, is_online int, date string, is_fraud int",
    ).withColumn("date", F.col("date").cast("timestamp"))
    r = requests.to_request(row).first().asDict()
    assert r["amount"] == 50.0 and r["is_online"] is True
    assert r["credit_limit"] is None and r["errors"] is None and r["has_chip"] is None
    assert "is_fraud" not in r
    back = row.withColumn("amount_to_credit_limit", F.lit(0.0125))
    assert requests.to_request(back).first()["credit_limit"] == pytest.approx(4000.0)


POINT = OperatingPoint(block=0.6, review=0.4)


def test_bands_are_closed_below(spark):
    df = spark.createDataFrame([(0.39999999,), (0.4,), (0.59999999,), (0.6,)], "raw_score double")
    rows = decisions.decide(df, POINT).orderBy("raw_score").collect()
    assert [r["decision"] for r in rows] == ["allow", "review", "review", "block"]
    assert rows[0]["risk_score"] == 0.4  # shown rounded, decided unrounded
    assert {r["gated"] for r in rows} == {False} and rows[3]["rule_id"].startswith("RULE_BLOCK")


def test_disagreement_notes(spark):
    cases = [(True, 0.5, "no warning sign"), (True, 2.0, ""), (False, 2.0, "lowers the score"), (False, 1.0, ""), (True, None, "")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, up boolean, lift double")
    got = [r[0] for r in df.orderBy("i").select(decisions.disagreement(F.col("up"), F.col("lift"))).collect()]
    assert all((want in g) if want else g == "" for g, (_, _, want) in zip(got, cases))


def test_top_factors_rank_by_size(spark):
    size = {f: (i - 7) / 10 for i, f in enumerate(FEATURES)}
    row = {**{f: ("x" if f in CATEGORICAL else 1.0) for f in FEATURES}, **{f"_contrib_{f}": v for f, v in size.items()}}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(
        f"{k} {'string' if k in CATEGORICAL else 'double'}" for k in row))
    (r,) = decisions.top_factors(df, context.Context()).collect()
    factors = r["top_factors"]
    assert [abs(f["contribution"]) for f in factors] == sorted((abs(v) for v in size.values()), reverse=True)[:6]
    assert factors[0]["feature"] == FEATURES[0] and factors[0]["direction"] == "decreases risk"


def service(spark):
    return scoring.Service(dictionaries(spark), POINT, formula=F.col("abs_amount") / 100)


def test_score_and_logs_hold_no_raw_input(spark):
    s = service(spark)
    scored = scoring.score(ask(spark, {"request_id": "r1", **FULL, "amount": 45.0}, {"amount": 90}).drop("body"), s)
    audit, cases = scoring.log_rows(scored, s)
    rows = {r["decision"]: r.asDict() for r in audit.collect()}
    assert set(rows) == {"review", "block"} and len(rows["review"]) == 18
    assert rows["review"]["request_id"] == "r1" and len(rows["review"]["input_sha256"]) == 64
    assert rows["block"]["request_id"] == rows["block"]["input_sha256"] + "-1"  # no id given: stable under retries
    assert "Visa" not in json.dumps(rows["review"], default=str)
    (case,) = cases.collect()
    assert case["request_id"] == "r1" and case["event"] == "queued" and case["merchant_category"] is None


def events(spark, rows):
    return spark.createDataFrame(
        [(e, i, t, s, 1.0, None, reason, a, None, None) for e, i, t, s, reason, a in rows], REVIEW_EVENT)


LOG = [("queued", "a", "1", 0.5, "score in review band", None), ("queued", "b", "2", 0.9, "gate downgrade", None),
       ("queued", "c", "3", None, "score in review band", None), ("resolved", "a", "4", 0.5, None, "approve")]


def test_queue_replay(spark):
    log = events(spark, LOG)
    rows = review.list_pending(log, 10).collect()
    assert [r["request_id"] for r in rows] == ["b", "c"] and rows[0]["queued_reason"] == "legacy gate review"
    assert len(review.list_pending(log, 0).collect()) == 1
    assert review.stats(log).first().asDict() == {"resolved": 1, "approved": 1, "declined": 0, "pending": 2}
    again = events(spark, LOG + [("queued", "a", "5", 0.7, "score in review band", None)])
    assert {r["request_id"] for r in review.pending(again).collect()} == {"a", "b", "c"}


def test_resolutions(spark):
    log = events(spark, LOG)
    asked = spark.createDataFrame(
        [("b", "6", "decline", "ana", "seen"), ("b", "7", "approve", "bo", None), ("a", "6", "approve", None, None),
         ("zz", "6", "approve", None, None), ("c", "6", "escalate", None, None), ("c", "7", "approve", "x" * 65, None),
         ("c", "8", "approve", None, "n" * 501)],
        "request_id string, ts string, action string, reviewer string, note string")
    done, rejected = review.resolve(log, asked)
    (d,) = done.collect()
    assert (d["request_id"], d["action"], d["reviewer"], d["risk_score"]) == ("b", "decline", "ana", 0.9)
    assert sorted((r["request_id"], r["ts"]) for r in rejected.collect()) == [
        ("a", "6"), ("b", "7"), ("c", "6"), ("c", "7"), ("c", "8"), ("zz", "6")]
    after = log.unionByName(done, allowMissingColumns=True)
    assert review.resolve(after, asked)[0].count() == 0  # replaying the batch changes nothing
    many = asked.union(asked).union(asked)
    done, rejected = review.resolve(log, many)
    assert done.count() == 1 and rejected.count() == many.count() - 1
    a = review.resolution_audit(done).first()
    assert a["decision"] == "human_review_resolved" and a["review_action"] == "decline"


def test_audit_reports(spark):
    audit = spark.createDataFrame(
        [("1", "a", "block", 0.9, 5.0), ("2", "b", "allow", 0.1, 6.0), ("3", "b", "human_review_resolved", 0.1, 6.0)],
        "ts string, request_id string, decision string, risk_score double, amount double")
    k = decisions.audit_kpis(audit).first()
    assert (k["decisions"], k["block_share"], k["hold_share"]) == (2, 0.5, 0.0)
    assert [r["when"] for r in decisions.recent(audit, 2).collect()] == ["3", "2"]
    truth = audit.withColumns({"is_fraud": F.lit(1), "raw_decision": F.col("decision")})
    assert [r["correct"] for r in decisions.outcome(truth).orderBy("ts").limit(2).collect()] == [True, False]


# ------------------------------------------------------------------ sources and streams


def test_label_map_is_split_at_commas(spark, tmp_path):
    path = tmp_path / "labels.json"
    path.write_text(json.dumps({"target": {str(i): ("Yes" if i % 3 == 0 else "No") for i in range(50)}}, indent=1))
    got = {r["id"]: r["is_fraud"] for r in readers.read_labels(spark, str(path)).collect()}
    assert got == {i: int(i % 3 == 0) for i in range(50)}


def test_code_list_and_dimensions(spark, tmp_path):
    (tmp_path / "codes.json").write_text(json.dumps({"5812": "Eating Places", "5942": "Books, Magazines"}))
    got = {r["mcc"]: r["name"] for r in readers.read_codes(spark, str(tmp_path / "codes.json")).collect()}
    assert got == {5812: "Eating Places", 5942: "Books, Magazines"}
    (tmp_path / "cards.csv").write_text(
        "id,client_id,card_brand,card_type,card_number,expires,cvv,has_chip,num_cards_issued,credit_limit,acct_open_date,"
        'year_pin_last_changed,card_on_dark_web\n7,1,Visa,Debit,4344,12/2022,623,YES,2,"$24,295",09/2002,2008,No\n')
    cards = readers.read_cards(spark, str(tmp_path / "cards.csv"))
    assert "cvv" not in cards.columns and cards.first()["credit_limit"] == "$24,295"


def test_logs_skip_broken_lines_and_default_to_empty(spark, tmp_path):
    assert readers.read_log(spark, str(tmp_path / "never")).count() == 0
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"event": "queued", "request_id": "a"}\n{"event": "que\n\n')
    assert [r["request_id"] for r in readers.read_log(spark, str(tmp_path / "log")).where("event is not null").collect()] == ["a"]
    assert sinks.read_document(spark, str(tmp_path / "none"), {"x": 1}) == {"x": 1}
    sinks.write_document(spark, str(tmp_path / "doc"), {"y": [1, 2]})
    assert sinks.read_document(spark, str(tmp_path / "doc")) == {"y": [1, 2]}


def test_shared_folder(spark):
    assert scratch(spark, "x").startswith(shared_dir(spark))
    kept = materialize(spark.range(5))
    assert kept.count() == 5 and "ExistingRDD" not in kept._jdf.queryExecution().toString()
    path = kept.table_path
    with scope(spark) as stay:
        inner, outer = materialize(spark.range(3)), materialize(spark.range(4))
        stay.append(outer)
    assert not os.path.exists(inner.table_path) and os.path.exists(outer.table_path) and os.path.exists(path)
    release(spark, [path, outer.table_path])
    assert not os.path.exists(path) and not os.path.exists(outer.table_path)


def test_stream_scores_once_even_if_a_batch_repeats(spark, tmp_path):
    for n in range(2):
        spark.createDataFrame([(f"r{n}{i}", 30.0 * i) for i in range(4)], "request_id string, amount double").coalesce(1).write.mode(
            "append").json(str(tmp_path / "in"))
    from riskloom.schema import REQUEST

    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run = lambda: streams.score_stream(stream, service(spark), str(tmp_path / "audit"), str(tmp_path / "queue"),
                                       str(tmp_path / "state")).awaitTermination()
    run()
    audit = spark.read.json(str(tmp_path / "audit"))
    assert audit.count() == 8 and audit.select("batch").distinct().count() == 2
    run()  # nothing new
    assert spark.read.json(str(tmp_path / "audit")).count() == 8
    first = audit.select("stream").first()[0]
    sinks.write_batch(materialize(audit.where("batch = 0").drop("batch", "stream")), str(tmp_path / "audit"), first, 0)
    assert spark.read.json(str(tmp_path / "audit")).count() == 8
    streams.score_stream(stream, service(spark), str(tmp_path / "audit"), str(tmp_path / "queue"), str(tmp_path / "other")).awaitTermination()
    assert spark.read.json(str(tmp_path / "audit")).count() == 16  # a new checkpoint leaves the old rows


def test_twins_stay_two_requests(spark):
    twins = spark.createDataFrame([(None, 31.0), (None, 31.0), (None, 40.0), ("own", 31.0)], "request_id string, amount double")
    ids = [sorted(r["request_id"] for r in scoring.score(twins.repartition(n), service(spark), origin="b1").collect()) for n in (1, 3)]
    assert len(set(ids[0])) == 4 and ids[0] == ids[1] and "own" in ids[0]


def test_review_stream_keeps_state_across_batches(spark, tmp_path):
    log = events(spark, LOG)
    log.where("event = 'queued'").coalesce(1).write.json(str(tmp_path / "in"))
    log.where("event = 'resolved'").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(REVIEW_EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{tmp_path}/out/b={number}")

    (streams.review_stream(stream).writeStream.outputMode("update").foreachBatch(keep)
     .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())
    got = {r["request_id"]: r["status"] for r in streams.latest_status(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert got == {"a": "approve", "b": "pending", "c": "pending"}


def test_review_stream_takes_any_order(spark, tmp_path):
    log = events(spark, LOG)
    for event in ("resolved", "queued"):
        log.where(F.col("event") == event).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(REVIEW_EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{tmp_path}/out/b={number}")

    (streams.review_stream(stream).writeStream.outputMode("update").foreachBatch(keep)
     .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())
    got = {r["request_id"]: r["status"] for r in streams.latest_status(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert got == {"a": "approve", "b": "pending", "c": "pending"}


def test_review_stream_drops_nothing_late(spark, tmp_path):
    """Files in reverse order of time, 200 days apart: status as in the batch fold."""
    days = [("2024-07-19", "resolved", "a", "approve"), ("2024-07-19", "queued", "late", None), ("2024-01-01", "queued", "a", None),
            ("2024-01-01", "queued", "b", None), ("2024-01-01", "queued", "c", None), ("2024-01-02", "resolved", "c", "decline")]
    log = spark.createDataFrame([(d + "T10:00:00", e, r, x) for d, e, r, x in days], "ts string, event string, request_id string, action string")
    for month in ("2024-07", "2024-01-02", "2024-01-01"):
        log.where(F.col("ts").startswith(month)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(REVIEW_EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{tmp_path}/out/b={number}")

    (streams.review_stream(stream).writeStream.outputMode("update").foreachBatch(keep)
     .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())
    got = {r["request_id"]: r["status"] for r in streams.latest_status(spark.read.parquet(f"{tmp_path}/out")).collect()}
    want = {r["request_id"]: "pending" if r["event"] == "queued" else r["action"] for r in review.state(log).collect()}
    assert got == want == {"a": "approve", "b": "pending", "c": "decline", "late": "pending"}


def test_snapshot_and_tail_equal_the_whole_log(spark, tmp_path):
    import random

    rng = random.Random(6)
    rows = [(rng.choice(["queued", "resolved", "other"]), f"r{rng.randrange(12)}", f"{k:03d}", rng.random(), "gate downgrade", rng.choice(["approve", "decline"])) for k in range(120)]
    rng.shuffle(rows)
    kept = review_log.ReviewLog(spark, f"{tmp_path}/log", f"{tmp_path}/store")
    assert kept.pending().count() == 0 and kept.compact() == 0
    same = lambda a, b: sorted(map(str, a.select(sorted(b.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect()))
    for k in range(6):
        kept.append(events(spark, rows[20 * k:20 * k + 20]), rng.choice("ab"), k)
        if k in (1, 2, 4):
            kept.compact()
        whole = events(spark, rows[:20 * k + 20])
        assert same(kept.state(), review.state(whole)) and same(kept.pending(), review.pending(whole)) and same(kept.stats(), review.stats(whole))
    plan = kept.tail()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "batch" in plan.split("PartitionFilters")[1].split("]")[0]
    assert kept.tail().select("batch").distinct().count() == 1  # only what came after the last snapshot


def test_damaged_artefacts_count_as_none_and_other_failures_show(spark, tmp_path, monkeypatch):
    from pyspark.errors import PySparkRuntimeError
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("x double, y double")
    os.makedirs(tmp_path / "broken")
    (tmp_path / "broken" / "x.parquet").write_text("not a table at all")
    spark.createDataFrame([("a", "b")], "x string, y string").write.parquet(str(tmp_path / "other"))
    spark.createDataFrame([(1.0, 2.0)], schema).write.parquet(str(tmp_path / "sound"))
    assert [len(readers.read_artefact(spark, str(tmp_path / n), schema)) for n in ("broken", "other", "none", "sound")] == [0, 0, 0, 1]

    def lost(*_):
        raise PySparkRuntimeError("an executor was lost")

    monkeypatch.setattr(readers, "read_or_empty", lost)
    with pytest.raises(PySparkRuntimeError):
        readers.read_artefact(spark, str(tmp_path / "sound"), schema)


def test_a_request_delivered_again_is_scored_once(spark, tmp_path):
    from riskloom.schema import REQUEST

    rows = [("a", 30.0), ("b", 60.0), ("a", 30.0), (None, 5.0), (None, 5.0)]
    for _ in range(2):
        spark.createDataFrame(rows, "request_id string, amount double").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run = lambda: streams.score_stream(stream, service(spark), str(tmp_path / "audit"), str(tmp_path / "queue"), str(tmp_path / "state"), once=True).awaitTermination()
    run()
    audit = spark.read.json(str(tmp_path / "audit")).collect()
    assert sorted(r.request_id for r in audit if r.request_id in "ab") == ["a", "b"] and len(audit) == 2 + 4  # requests without an id are each of their own
    assert all(r.latency_ms > 0 for r in audit)
    spark.createDataFrame([("b", 60.0), ("c", 1.0)], "request_id string, amount double").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    run()  # the state outlives the query
    assert sorted(r.request_id for r in spark.read.json(str(tmp_path / "audit")).collect() if len(r.request_id) == 1) == ["a", "b", "c"]


def test_response_says_all_that_the_caller_needs(spark):
    r = scoring.respond(spark.createDataFrame([("x", 142.5)], "request_id string, amount double"), service(spark), latency_ms=2.5).first()
    assert r.thresholds.review <= r.thresholds.block and r.raw_decision == r.decision and not r.gated and r.gate_reason is None
    assert r.latency_ms == 2.5 and r.model_version == service(spark).point.version and r.explained_by == service(spark).point.explainer


def test_many_levels_are_joined_like_few(spark, tmp_path, monkeypatch):
    known = [f"level {k}" for k in range(100_000)]
    asked = spark.createDataFrame([(1, 5.0, "level 99999"), (2, 5.0, "none of them"), (3, 5.0, None)], "i int, amount double, mcc_category string")
    made = requests.featurize(requests.as_requests(asked), requests.Dictionaries(levels={"mcc_category": known})).orderBy("i").collect()
    assert [r.mcc_category for r in made] == ["level 99999", None, None]

    rates = spark.range(1100).selectExpr("'mcc_category' AS feature", "concat('level ', id) AS level", "id / 2200 AS fraud_rate", "id + 200 AS n").union(
        spark.createDataFrame([("is_online", "yes", 0.5, 300)], "feature string, level string, fraud_rate double, n bigint"))
    none = spark.createDataFrame([], "feature string, q double, value double")
    wide = context.load_context(none, rates, None, 0.1, 10)
    assert list(wide.tables) == ["mcc_category"] and list(wide.rates) == ["is_online"] and wide.available
    monkeypatch.setattr(context, "LITERALS", 10_000)
    few = context.load_context(none, rates, None, 0.1, 10)
    assert not few.tables
    rows = spark.createDataFrame([(k, f"level {v}" if v is not None else None) for k, v in enumerate((0, 1, 1099, 1100, None))], "i int, mcc_category string")

    def told(ctx):
        e = context.evidence("mcc_category", ctx)
        return context.with_level_rates(rows, ctx, ["mcc_category"]).select("i", e["lift"].alias("lift"), e["evidence"].alias("e")).orderBy("i").collect()

    assert told(wide) == told(few) and told(wide)[2].lift == 5.0
    monkeypatch.undo()
    context.save(wide, spark, str(tmp_path / "context"))
    assert told(context.load(spark, str(tmp_path / "context"))) == told(few)
