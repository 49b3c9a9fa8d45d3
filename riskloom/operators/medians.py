"""Typical spend learned on the training period and applied unchanged to later rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.features import safe_ratio
from riskloom.operators.ordering import exact_quantiles
from riskloom.operators.skew import left_lookup
from riskloom.sources.shared import materialize


@dataclass
class Medians:
    card: DataFrame
    category: DataFrame
    overall: DataFrame


def fit(train: DataFrame, amount: str = "abs_amount", card: str = "card_id",
        category: str = "mcc_category") -> Medians:
    """Exact medians per card, per category and overall. Call it on training rows only.

    The three groupings share one pass: each row is counted once per scope, and counts of equal
    amounts are merged before anything is shuffled.
    """
    scopes = F.array(*[
        F.struct(F.lit(scope).alias("scope"), key.cast("string").alias("level"), F.col(amount).alias("v"))
        for scope, key in (("card", F.col(card)), ("category", F.col(category)), ("global", F.lit("")))])
    long = train.select(F.inline(scopes))
    found = materialize(exact_quantiles(long, "v", [0.5], ["scope", "level"]).select(
        "scope", "level", F.col("value").alias("med")))
    kinds = {f.name: f.dataType for f in train.schema.fields}
    of = lambda scope, name: found.where(F.col("scope") == scope).select(
        F.col("level").cast(kinds[name]).alias(name), "med")
    return Medians(of("card", card), of("category", category),
                   found.where(F.col("scope") == "global").select("med"))


def apply(df: DataFrame, fitted: Medians, amount: str = "abs_amount", card: str = "card_id",
          category: str = "mcc_category") -> DataFrame:
    """Amount over the median of its card and of its category; unknown keys use the overall one."""
    overall = fitted.overall.scalar()
    out = left_lookup(df, fitted.card.withColumnRenamed("med", "_card_med"), card)
    out = left_lookup(out, fitted.category.withColumnRenamed("med", "_cat_med"), category)
    return out.withColumns({
        "amount_vs_card_median": safe_ratio(F.col(amount), F.coalesce("_card_med", overall)),
        "amount_vs_mcc_median": safe_ratio(F.col(amount), F.coalesce("_cat_med", overall)),
    }).drop("_card_med", "_cat_med")
