from datetime import datetime

import pytest
from pyspark.sql import functions as F

from riskloom import schema
from riskloom.functions import features, hashing, parsing, text


def one(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_money(spark):
    got = one(spark, ["$-77.00", "$14.57", "$1,234.50", None, "oops", ""], "string", parsing.money)
    assert got == [-77.0, 14.57, 1234.5, None, None, None]


def test_yes_flag_never_null(spark):
    assert one(spark, ["YES", "yes", " No ", "no", None], "string", parsing.yes_flag) == [1, 1, 0, 0, 0]


def test_errors_and_zip(spark):
    errors = [None, "Bad PIN", "Bad CVV,Bad PIN", ""]
    assert one(spark, errors, "string", parsing.has_error) == [0, 1, 1, 0]
    assert one(spark, errors, "string", parsing.error_kind) == ["none", "Bad PIN", "Bad CVV", "none"]
    spaced = [" Bad CVV ,x", "  ", None]
    assert one(spark, spaced, "string", lambda c: parsing.error_kind(c, trim=True)) == ["Bad CVV", "", "none"]
    assert one(spark, spaced, "string", parsing.error_kind)[0] == " Bad CVV "
    assert one(spark, [90210.0, None, 0.0], "double", parsing.card_not_present) == [0, 1, 0]
    assert one(spark, ["CA", None], "string", parsing.merchant_state) == ["CA", "ONLINE"]


def test_bad_timestamp_fails_the_job(spark):
    assert one(spark, ["2019-06-14 02:31:00"], "string", parsing.instant) == [datetime(2019, 6, 14, 2, 31)]
    with pytest.raises(Exception):
        one(spark, ["14/06/2019"], "string", parsing.instant)


def test_row_features(spark):
    # 2019-06-15 is a Saturday.
    row = spark.sql("select timestamp'2019-06-15 05:59:59' ts").select(
        *[c.alias(n) for n, c in features.calendar(F.col("ts")).items()]).first()
    assert row.asDict() == {"hour": 5, "day_of_week": 5, "day_of_month": 15, "month": 6, "is_night": 1, "is_weekend": 1}
    got = one(spark, [0.0, None, 4.0], "double", lambda v: features.safe_ratio(F.lit(8.0), v))
    assert got == [None, None, 2.0]
    ages = one(spark, ["06/2018", "13/2018", None], "string",
               lambda v: features.card_age_years(F.to_timestamp(F.lit("2019-06-01 23:00:00")), v))
    assert ages[0] == pytest.approx(365 / 365.25) and ages[1:] == [None, None]


def test_display(spark):
    assert one(spark, [0.0466, None, float("nan"), 0.00125], "double", text.percent) == ["4.66%", "n/a", "n/a", "0.12%"]
    assert one(spark, [0.0123, -0.5], "double", text.signed_percent) == ["+1.23%", "-50.00%"]
    assert one(spark, [1234567.5, None], "double", text.money_text) == ["1,234,568", "n/a"]
    assert one(spark, [76.94, float("inf")], "double", text.times) == ["76.9x", "n/a"]


@pytest.mark.parametrize("x", [0.0, 1.0, 0.5, 12.3456, 1234.56, 9999.6, 12345.6, 0.00012345, 0.000012345, -3.14159, 100.0])
def test_four_digits_matches_general_format(spark, x):
    assert one(spark, [x], "double", text.four_digits) == [f"{x:,.4g}"]


def test_feature_values(spark):
    show = lambda name, v, kind="double": one(spark, [v], kind, lambda c: text.feature_value(name, c))[0]
    assert show("abs_amount", 1234.5) == "1,234.50"
    assert show("log_amount", 0.0) == "0.00"
    assert show("hour", 7.0) == "07:00"
    assert (show("has_chip", 1.0), show("has_chip", 0.0), show("has_chip", None)) == ("yes", "no", "not provided")
    assert show("card_brand", "Visa", "string") == "Visa"


def test_roles(spark):
    assert not set(schema.FEATURES) & set(schema.DROPPED)
    assert not set(schema.VELOCITY) & set(schema.FEATURES)
    assert len(schema.FEATURES) == 14
    for banned in ("merchant_state", "client_id", "card_id", "yearly_income", "card_number", "month"):
        assert banned in schema.DROPPED
    assert all(f in schema.LABELS for f in schema.FEATURES + schema.VELOCITY)
    names = spark.createDataFrame([("hour",), ("unheard_of",)], "n string").select(schema.label_of(F.col("n"))).collect()
    assert [r[0] for r in names] == ["hour of day", "unheard_of"]
    with pytest.raises(ValueError):
        schema.check_roles(spark.range(1))


def test_fingerprint(spark):
    import hashlib

    raw = {"amount": 10000000.0, "date": None, "has_chip": True, "mcc": 5812}
    df = spark.createDataFrame([tuple(raw.values())], "amount double, date string, has_chip boolean, mcc int")
    want = hashlib.sha256("|".join(f"{k}={raw[k]}" for k in sorted(raw)).encode()).hexdigest()
    assert df.select(hashing.fingerprint(df)).first()[0] == want
    # A missing value and an absent pair must not collide.
    a = spark.createDataFrame([("x", None)], "errors string, date string")
    b = spark.createDataFrame([(None, "x")], "errors string, date string")
    assert a.select(hashing.fingerprint(a)).first() != b.select(hashing.fingerprint(b)).first()


@pytest.mark.parametrize("x", [142.5, 1e7, 1e12, 0.0001, 0.00123, -5.0, 0.0, 123456789.25])
def test_plain_number(spark, x):
    assert one(spark, [x], "double", hashing.plain_number) == [str(x)]
