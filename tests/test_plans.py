import json

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import context, requests, splits
from riskloom.operators.metrics import ap_value
from riskloom.plans import assess, attribution, modelling, prepare, scoring, train, tuning
from riskloom.schema import FEATURES, VELOCITY
from riskloom.sources import readers, sinks
from riskloom.sources.shared import materialize

SMALL = {"gbt": {"rounds": 6, "depth": 3, "rate": 0.3}, "forest": {"numTrees": 6, "maxDepth": 4}, "linear": {"maxIter": 15}}


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    """Raw files in which fraud does depend on the features."""
    root = tmp_path_factory.mktemp("raw")
    rng = np.random.default_rng(5)
    lines, labels = ["id,date,client_id,card_id,amount,use_chip,merchant_id,merchant_state,zip,mcc,errors"], {}
    for i in range(3000):
        online = rng.random() < 0.3
        amount = float(np.round(rng.gamma(2, 40), 2))
        fraud = rng.random() < (0.45 if online and amount > 100 else 0.01)
        minute = i * 37
        stamp = f"2018-{1 + minute // 40320:02d}-{1 + minute // 1440 % 28:02d} {minute // 60 % 24:02d}:{minute % 60:02d}:00"
        lines.append(f"{i},{stamp},{i % 40},{i % 60},\"${amount:,.2f}\",{'Online' if online else 'Chip'} Transaction,9,"
                     f"{'' if online else 'CA'},{'' if online else 90210},{5812 if i % 2 else 5942},{'Bad PIN' if i % 50 == 0 else ''}")
        if i % 100 != 7:
            labels[str(i)] = "Yes" if fraud else "No"
    (root / "transactions_data.csv").write_text("\n".join(lines))
    (root / "train_fraud_labels.json").write_text(json.dumps({"target": labels}))
    (root / "mcc_codes.json").write_text(json.dumps({"5812": "Eating Places", "5942": "Book Stores"}))
    (root / "cards_data.csv").write_text("\n".join(
        ["id,card_brand,card_type,has_chip,num_cards_issued,credit_limit,acct_open_date,year_pin_last_changed,card_on_dark_web"]
        + [f"{i},{['Visa', 'Amex'][i % 2]},Debit,{['YES', 'NO'][i % 2]},1,$%d,0{1 + i % 9}/2010,2012,No" % (i * 100) for i in range(60)]))
    (root / "users_data.csv").write_text("\n".join(
        ["id,current_age,gender,per_capita_income,yearly_income,total_debt,credit_score,num_credit_cards"]
        + [f"{i},40,Male,$20000,$50000,$1000,700,2" for i in range(40)]))
    return str(root)


@pytest.fixture(scope="module")
def table(spark, raw, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    prepare.run(spark, raw, out)
    return out


def test_prepare_writes_a_clean_split_table(spark, table):
    t = readers.read_split(spark, f"{table}/splits")
    assert t.count() == 2970 and set(VELOCITY) <= set(t.columns) and "merchant_state" not in t.columns
    n = {r["split"]: r["count"] for r in t.groupBy("split").count().collect()}
    assert n == {"train": 2435, "val": 237, "test": 267, "demo": 31}
    splits.assert_no_leakage(t)
    r = t.where("id = 1").first()
    assert r["amount_to_credit_limit"] == pytest.approx(r["abs_amount"] / 100) and r["mcc_category"] == "Eating Places"
    assert t.where("amount_to_credit_limit is null").count() > 0  # card 0 has a zero limit
    assert readers.read_split(spark, f"{table}/category_medians").count() == 2
    plan = readers.read_split(spark, f"{table}/splits", "test", ["id"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "ReadSchema: struct<id:bigint>" in plan


@pytest.fixture(scope="module")
def fitted(spark, table):
    rows = materialize(splits.val_cut(readers.read_split(spark, f"{table}/splits")))
    part = lambda s: rows.where(F.col("split") == s)
    levels = requests.levels_dict(context.learn_levels(part("train")))
    members = {n: modelling.fit(n, part("train"), part("val_fit"), levels, SMALL[n], 60.0) for n in modelling.FAMILIES}
    return rows, levels, members


def test_protocol_is_enforced(spark, fitted):
    rows, levels, _ = fitted
    with pytest.raises(ValueError):
        modelling.fit("linear", rows, rows.where("split = 'val_fit'"), levels)
    with pytest.raises(ValueError):
        assess.predict_all({}, rows)


def test_models_learn(spark, fitted):
    rows, _, members = fitted
    test = rows.where("split in ('val_sel', 'test')")
    base = test.agg(F.avg("is_fraud")).first()[0]
    for name, m in members.items():
        out = modelling.predict(m, test, "score")
        assert ap_value(out) > 2.5 * base, name
        lo, hi = out.agg(F.min("score"), F.max("score")).first()
        assert 0 <= lo <= hi <= 1
        assert m.info["rows_used"] == 2435 and 0 < m.info["effective_sample_size"] < 2435


def test_unseen_and_missing_inputs_still_score(spark, fitted):
    rows, _, members = fitted
    odd = rows.where("split = 'test'").limit(3).withColumns({
        "card_brand": F.lit("never seen"), "hour": F.lit(None).cast("int"), "use_chip": F.lit(None).cast("string")})
    for m in members.values():
        assert modelling.predict(m, odd, "score").where("score is not null").count() == 3


def test_saved_members_come_back_and_absent_ones_are_skipped(spark, fitted, tmp_path):
    rows, _, members = fitted
    modelling.save(members["linear"], str(tmp_path))
    back = modelling.load(spark, str(tmp_path))
    assert set(back) == {"linear"}
    test = rows.where("split = 'test'")
    a = modelling.predict(members["linear"], test, "s").agg(F.sum("s")).first()[0]
    assert modelling.predict(back["linear"], test, "s").agg(F.sum("s")).first()[0] == pytest.approx(a)


@pytest.mark.parametrize("name", ["gbt", "forest"])
def test_tree_contributions_add_up(spark, fitted, name):
    rows, _, members = fitted
    m = members[name]
    out = attribution.with_contributions(m, modelling.predict(m, rows.where("split = 'test'"), "p"))
    got = out.select("p", sum([F.col(f"_contrib_{f}") for f in FEATURES][1:], F.col(f"_contrib_{FEATURES[0]}")).alias("c")).collect()
    p = np.array([r["p"] for r in got])
    target = np.log(p / (1 - p)) if name == "gbt" else p
    base = target - np.array([r["c"] for r in got])
    assert np.ptp(base) < 1e-8  # score = constant + contributions, for every row
    if name == "gbt":
        top = out.agg(*[F.avg(F.abs(f"_contrib_{f}")).alias(f) for f in FEATURES]).first().asDict()
        assert max(top, key=top.get) in ("abs_amount", "log_amount", "is_online", "use_chip", "amount_vs_mcc_median")


def test_shapley_against_enumeration():
    from itertools import permutations

    leaves = [(3.0, [(0, 0.5, None, True, 0.3), (1, 0.5, None, False, 0.6), (0, 0.2, None, False, 0.5)]),
              (-1.0, [(1, None, [1.0, 2.0], True, 0.25)])]
    x = np.array([[0.3, 2.0], [0.9, 0.0], [0.1, 1.0]])

    def value(row, known):
        total = 0.0
        for leaf, steps in leaves:
            w = leaf
            for slot, thr, cats, left, share in steps:
                ok = (row[slot] <= thr if cats is None else row[slot] in cats) == left
                w *= float(ok) if slot in known else share
            total += w
        return total

    phi = attribution.shapley(x, leaves, [0, 1], 2)
    for i, row in enumerate(x):
        want = np.zeros(2)
        for order in permutations(range(2)):
            seen = set()
            for p in order:
                want[p] += (value(row, seen | {p}) - value(row, seen)) / 2
                seen.add(p)
        assert phi[i] == pytest.approx(want)


def test_linear_contributions_add_up(spark, fitted):
    rows, _, members = fitted
    m = members["linear"]
    test = modelling.predict(m, rows.where("split = 'test'"), "p")
    out = attribution.with_contributions(m, test, rows.where("split = 'train'"))
    got = out.select("p", sum([F.col(f"_contrib_{f}") for f in FEATURES][1:], F.col(f"_contrib_{FEATURES[0]}")).alias("c")).collect()
    base = [np.log(r["p"] / (1 - r["p"])) - r["c"] for r in got]
    assert np.ptp(base) < 1e-6


def test_training_resumes_and_a_service_is_assembled(spark, table, tmp_path):
    out, names = str(tmp_path), ("gbt", "linear")
    members, weights = train.run(spark, f"{table}/splits", out, names, SMALL)
    assert set(weights) == set(names) and abs(sum(weights.values()) - 1) < 1e-9
    about = sinks.read_document(spark, f"{out}/training_summary")
    assert [m["restored"] for m in about["models"]] == [False, False] and about["val_rows"] == 237
    train.run(spark, f"{table}/splits", out, names, SMALL)
    again = sinks.read_document(spark, f"{out}/training_summary")
    assert [m["restored"] for m in again["models"]] == [True, True]
    assert [m["val_average_precision"] for m in again["models"]] == [m["val_average_precision"] for m in about["models"]]

    rows = materialize(splits.val_cut(readers.read_split(spark, f"{table}/splits")))
    a = assess.run(assess.predict_all(members, rows.where("split <> 'train'")), list(members), ship="gbt", n_boot=5)
    assess.save(a, out)
    ctx = context.build(rows.where("split = 'train'"), 30.0, a.scored_val)
    context.save(ctx, spark, f"{out}/context")
    assert context.load(spark, f"{out}/context") == ctx and not context.load(spark, f"{out}/none").available
    service = scoring.load_service(spark, out)
    assert set(service.members) == {"gbt"} and service.point.explainer == "gbt" and service.context.bands
    asked = spark.createDataFrame([("r", 500.0, "Online Transaction")], "request_id string, amount double, use_chip string")
    (r,) = scoring.score(asked, service).collect()
    assert 0 <= r["risk_score"] <= 1 and len(r["top_factors"]) == 6 and "date" in r["missing_fields"]


def test_half_life_of_the_served_model():
    infos = {"gbt": {"recency_half_life_days": 0}, "forest": {"recency_half_life_days": 60}}
    assert train.shipped_half_life(infos, "ensemble") == 60
    assert train.shipped_half_life(infos, "gbt") == 0 and train.shipped_half_life({}, "forest") == 0


def test_search_resumes(spark, fitted, tmp_path):
    rows, levels, _ = fitted
    tr, vf = rows.where("split = 'train'"), rows.where("split = 'val_fit'")
    path = str(tmp_path / "trials")
    first = tuning.tune(spark, "linear", tr, vf, levels, path, trials=1).collect()
    both = tuning.tune(spark, "linear", tr, vf, levels, path, trials=2)
    assert both.count() == 2 and both.where("number = 0").first() == first[0]
    assert first[0]["value"] is not None and first[0]["half_life"] in tuning.HALF_LIVES
    params, half_life = tuning.best(both)
    assert 20 <= params["maxIter"] <= 100 and 0 <= params["elasticNetParam"] <= 1
    assert tuning.suggest("gbt", 3) == tuning.suggest("gbt", 3) != tuning.suggest("gbt", 4)


def test_assessment_and_scoring_end_to_end(spark, fitted, tmp_path):
    rows, levels, members = fitted
    predictions = assess.predict_all(members, rows.where("split <> 'train'"))
    a = assess.run(predictions, list(members), n_boot=30)
    r = a.report
    assert r["test_rows"] == 267 and r["selection_bias"] >= -1e-9 and r["cost_optimal"]["total_cost"] <= r["do_nothing_cost"]
    assert abs(sum(a.weights.values()) - 1) < 1e-9 and 0 <= a.point.review < a.point.block
    assert r["calibration"]["ece_after"] < r["calibration"]["ece_before"]
    assert a.board.where("shipped").count() == 1 and a.board.count() == 4 and a.sweep.count() == 99
    pinned = assess.run(predictions, list(members), ship="linear", n_boot=5)
    assert pinned.point.model == "linear" and pinned.report["shipped_by_override"] == (r["best_on_val_fit"] != "linear")
    assess.save(a, str(tmp_path))
    point, weights = assess.load_point(spark, str(tmp_path))
    assert (point.block, point.review, point.knots_x) == (a.point.block, a.point.review, a.point.knots_x)
    assert weights == a.weights
    assert assess.load_point(spark, str(tmp_path / "none"))[0].block == 0.5

    history = rows.where("split = 'train'")
    ctx = context.build(history, 60.0, a.scored_val)
    point.explainer = "gbt"
    service = scoring.Service(requests.Dictionaries(None, None, 60.0, levels), point, members, weights, ctx)
    asked = requests.to_request(rows.where("split = 'demo'")).withColumn("request_id", F.col("id").cast("string"))
    out = scoring.score(asked, service).collect()
    assert len(out) == 31
    for row in out:
        assert len(row["top_factors"]) == 6 and row["decision"] in ("allow", "review", "block") and row["base_rate"] is not None
    log = spark.createDataFrame([], "event string, request_id string, ts string, risk_score double, queued_reason string, action string")
    h = scoring.health(spark, service, log).first()
    assert h["pending"] == 0 and h["context_available"] and h["reference_rows"] == history.where("is_fraud = 0").count()
