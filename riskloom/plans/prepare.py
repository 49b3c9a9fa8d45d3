"""Raw inputs to the split feature table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import features, parsing
from riskloom.operators import medians, splits
from riskloom.operators.skew import check_unique, left_lookup
from riskloom.operators.velocity import add_velocity
from riskloom.schema import MONEY_COLUMNS
from riskloom.sources import readers, sinks
from riskloom.sources.shared import materialize


@dataclass
class Prepared:
    table: DataFrame
    medians: medians.Medians


def join_context(rows: DataFrame, cards: DataFrame, users: DataFrame, codes: DataFrame) -> DataFrame:
    for dim, key in ((cards, "card_id"), (users, "client_id"), (codes, "mcc")):
        check_unique(dim, key)
    out = left_lookup(left_lookup(rows, cards, "card_id"), users, "client_id")
    out = left_lookup(out, codes, "mcc")
    return out.withColumn("mcc_category", F.coalesce("name", F.lit("Unknown"))).drop("name")


def clean(df: DataFrame) -> DataFrame:
    money = {c: parsing.money(F.col(c)) for c in MONEY_COLUMNS if c in df.columns}
    out = df.withColumns({
        **money,
        "date": parsing.instant(F.col("date")),
        "has_chip": parsing.yes_flag(F.col("has_chip")),
        "card_on_dark_web": parsing.yes_flag(F.col("card_on_dark_web")),
        "has_error": parsing.has_error(F.col("errors")),
        "error_kind": parsing.error_kind(F.col("errors")),
        "is_online": parsing.card_not_present(F.col("zip")),
        "merchant_state": parsing.merchant_state(F.col("merchant_state")),
    })
    return out.withColumns(features.amounts(F.col("amount")))


def row_features(df: DataFrame) -> DataFrame:
    """Everything that needs only the row itself."""
    ts = F.col("date")
    return df.withColumns({
        **features.calendar(ts),
        **features.ratios(F.col("abs_amount"), F.col("credit_limit"), F.col("yearly_income"), F.col("total_debt")),
        "card_age_years": features.card_age_years(ts, F.col("acct_open_date")),
        "years_since_pin_change": features.years_since_pin_change(ts, F.col("year_pin_last_changed")),
    })


def build(rows: DataFrame) -> Prepared:
    """Cleaned rows to labelled splits with all features.

    Velocity looks only backwards and is computed over the whole timeline; medians are fitted on
    the training split alone. The split and the windows are computed once and written out, since
    medians, checks and the final table all read them.
    """
    split = materialize(splits.time_split(add_velocity(rows), source=rows))
    fitted = medians.fit(split.where("split = 'train'"))
    table = medians.apply(row_features(split), fitted)
    splits.assert_no_leakage(split)
    return Prepared(table, fitted)


def run(spark: SparkSession, raw: str, out: str) -> Prepared:
    """Read ``raw``, write the split table, the medians and the summary below ``out``."""
    labels = readers.read_labels(spark, f"{raw}/train_fraud_labels.json")
    rows = readers.read_transactions(spark, f"{raw}/transactions_data.csv", labels)
    joined = join_context(rows, readers.read_cards(spark, f"{raw}/cards_data.csv"),
                          readers.read_users(spark, f"{raw}/users_data.csv"),
                          readers.read_codes(spark, f"{raw}/mcc_codes.json"))
    # Text is parsed once; counts, boundaries and windows then read single columns of a columnar table.
    prepared = build(materialize(clean(joined)))
    sinks.write_splits(prepared.table, f"{out}/splits")
    sinks.write_small(prepared.medians.category, f"{out}/category_medians")
    sinks.write_small(prepared.medians.overall, f"{out}/global_median")
    sinks.write_small(splits.split_summary(readers.read_split(spark, f"{out}/splits")), f"{out}/split_summary", "json")
    return prepared
