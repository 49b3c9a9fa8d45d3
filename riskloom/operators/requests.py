"""Scoring requests: validation, and the same features the batch build makes. Works on streams."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import parsing
from riskloom.functions.features import safe_ratio
from riskloom.operators.skew import LITERALS, left_lookup
from riskloom.schema import CATEGORICAL, FEATURES, REQUEST

MAX_AMOUNT = 1e9


# ------------------------------------------------------------------------ validation


def parse_json(df: DataFrame, body: str = "body") -> DataFrame:
    """JSON text to request columns plus ``reject_reason`` (NULL when the request is sound).

    Every field is read as text first, so that one bad field is named instead of blanking the
    whole record.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in REQUEST.fields]
                        + [T.StructField("_corrupt", T.StringType())])
    parsed = df.withColumn("_r", F.from_json(
        F.col(body), text, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    typed = {f.name: _typed(F.col(f"_r.{f.name}"), f.dataType) for f in REQUEST.fields}
    bad_type = F.coalesce(*[
        F.when(F.col(f"_r.{f.name}").isNotNull() & typed[f.name].isNull(), F.lit(f"{f.name} has the wrong type"))
        for f in REQUEST.fields if not isinstance(f.dataType, T.StringType)])
    broken = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    reason = F.when(broken, "not a JSON object").otherwise(F.coalesce(bad_type, amount_problem(typed["amount"])))
    return parsed.withColumns({**typed, "reject_reason": reason}).drop("_r")


def _typed(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DoubleType):
        return text.try_cast("double")
    if isinstance(kind, T.IntegerType):
        number = text.try_cast("double")
        return F.when(number == F.floor(number), number.try_cast("int"))
    if isinstance(kind, T.BooleanType):
        return F.when(F.lower(text) == "on", True).when(F.lower(text) == "off", False).otherwise(text.try_cast("boolean"))
    return text


def amount_problem(amount: Column) -> Column:
    return (
        F.when(amount.isNull(), "amount is required")
        .when(F.isnan(amount) | (F.abs(amount) == float("inf")), "amount must be a finite number")
        .when(F.abs(amount) > MAX_AMOUNT, "amount is implausibly large")
    )


# ----------------------------------------------------------------------- featurisation


@dataclass
class Dictionaries:
    """Small training-time tables the featuriser looks things up in."""

    category_names: DataFrame | None = None  # (mcc int, name string)
    category_medians: DataFrame | None = None  # (mcc_category string, med double)
    global_median: float = 0.0
    levels: dict[str, list[str]] = field(default_factory=dict)


def levels_dict(levels: DataFrame) -> dict[str, list[str]]:
    """The level table as a dictionary; its size is the number of trained levels."""
    out: dict[str, list[str]] = {}
    for r in levels.orderBy("column", "level").collect():
        out.setdefault(r["column"], []).append(r["level"])
    return out


def _blank(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def card_not_present(is_online: Column, zip_code: Column, use_chip: Column, zip_key: bool) -> Column:
    """An explicit flag wins; then an absent ZIP; without any ZIP field, how the card was used."""
    if zip_key:
        fallback = _blank(zip_code) | (zip_code == 0)
    else:
        fallback = F.lower(F.coalesce(use_chip, F.lit(""))).contains("online")
    return F.coalesce(is_online.cast("double"), F.coalesce(fallback, F.lit(True)).cast("double"))


def featurize(df: DataFrame, dicts: Dictionaries, zip_key: bool = True) -> DataFrame:
    """Add the model features and ``missing_fields`` to request columns.

    Absent fields stay NULL: nothing is invented, and what was absent is listed.
    """
    out = df
    if dicts.category_names is not None:
        names = dicts.category_names.select("mcc", F.col("name").alias("_name"))
        out = left_lookup(out, names, "mcc")
    else:
        out = out.withColumn("_name", F.lit(None).cast("string"))
    given = F.when(~_blank(F.col("mcc_category")), F.col("mcc_category"))
    named = F.when(~_blank(F.col("_name")), F.col("_name"))
    out = out.withColumn("_cat", F.coalesce(given, named)).drop("_name")
    if dicts.category_medians is not None:
        meds = dicts.category_medians.select(F.col("mcc_category").alias("_cat"), F.col("med").alias("_med"))
        out = left_lookup(out, meds, "_cat")
    else:
        out = out.withColumn("_med", F.lit(None).cast("double"))

    size = F.abs(F.coalesce(F.col("amount"), F.lit(0.0)))
    stamp = F.when(~_blank(F.col("date")), F.col("date").try_cast("timestamp_ntz"))
    hour = F.hour(stamp).cast("double")
    no_limit = F.col("credit_limit").isNull() | (F.col("credit_limit") == 0)
    median = F.coalesce(F.nullif(F.col("_med"), F.lit(0.0)), F.lit(float(dicts.global_median)))
    gaps = [
        F.when(stamp.isNull(), "date"),
        F.when(F.col("_cat").isNull(), "mcc"),
        F.when(no_limit, "credit_limit"),
        F.when(F.col("_cat").isNull(), "mcc_category"),
        *[F.when(F.col(c).isNull(), c) for c in ("use_chip", "card_brand", "card_type")],
    ]
    if not zip_key:
        gaps.append(F.when(F.col("is_online").isNull(), "zip"))
    made = {
        "missing_fields": F.array_sort(F.array_distinct(F.array_compact(F.array(*gaps)))),
        "abs_amount": size,
        "log_amount": F.log1p(size),
        "amount_to_credit_limit": F.when(~no_limit, size / F.col("credit_limit")),
        "amount_vs_mcc_median": safe_ratio(size, median),
        "hour": hour,
        "is_night": (hour < 6).cast("double"),
        "is_online": card_not_present(F.col("is_online"), F.col("zip"), F.col("use_chip"), zip_key),
        "has_error": parsing.has_error(F.col("errors")).cast("double"),
        "has_chip": F.col("has_chip").cast("double"),
        "error_kind": parsing.error_kind(F.col("errors"), trim=True),
        "mcc_category": F.col("_cat"),
    }
    out = out.withColumns(made).drop("_cat", "_med")
    for c in CATEGORICAL:
        known = dicts.levels.get(c)
        if known and len(known) <= LITERALS:
            out = out.withColumn(c, F.when(F.col(c).isin(known), F.col(c)))
        elif known:
            table = df.sparkSession.createDataFrame([(v, True) for v in known], f"`{c}` string, _known boolean")
            out = left_lookup(out, table, c).withColumn(c, F.when(F.col("_known"), F.col(c))).drop("_known")
    return out


def to_request(df: DataFrame) -> DataFrame:
    """Rebuild a request from a stored feature row; the label never travels along.

    The limit is recovered from its ratio, ``none`` reads as no error, empty text as absent.
    """
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    ratio = F.col("amount_to_credit_limit")
    return df.select(
        *[c for c in ("id",) if c in df.columns],
        F.col("abs_amount").cast("double").alias("amount"),
        F.date_format("date", parsing.DATE_FORMAT).alias("date"),
        text("use_chip").alias("use_chip"), text("mcc_category").alias("mcc_category"),
        text("card_brand").alias("card_brand"), text("card_type").alias("card_type"),
        F.col("has_chip").cast("boolean").alias("has_chip"),
        F.coalesce(F.col("is_online").cast("boolean"), F.lit(False)).alias("is_online"),
        F.when(F.col("error_kind") != "none", text("error_kind")).alias("errors"),
        F.when(ratio > 0, F.col("abs_amount") / ratio).alias("credit_limit"),
    )


def as_requests(df: DataFrame) -> DataFrame:
    """Give a frame every request column, absent ones as typed NULLs."""
    return df.select(*[c for c in df.columns if c not in REQUEST.fieldNames()], *[
        (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in REQUEST.fields])


FEATURE_COLUMNS = FEATURES
