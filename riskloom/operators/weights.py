"""Training weights: class balance times recency, normalised to mean one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.features import clock
from riskloom.schema import LABEL

DAY_US = 86_400_000_000.0


def class_weight(df: DataFrame, label: str = LABEL, into: str = "class_weight") -> DataFrame:
    """Positives weigh negatives / positives, negatives weigh 1."""
    spw = df.agg(((F.count(F.lit(1)) - F.sum(label)) / F.greatest(F.sum(label), F.lit(1))).alias("spw"))
    return df.withColumn(into, F.when(F.col(label) == 1, spw.scalar()).otherwise(F.lit(1.0)))


def recency(age_days: Column, half_life: float | Column | None) -> Column:
    """0.5 ** (age / half-life) with age floored at 0; no half-life means weight 1."""
    if half_life is None:
        return F.lit(1.0)
    h = half_life if isinstance(half_life, Column) else F.lit(float(half_life))
    decay = F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / F.nullif(h.cast("double"), F.lit(0.0)))
    return F.when(h > 0, decay).otherwise(F.lit(1.0))


def with_age(df: DataFrame, ts: str = "date", reference: Column | None = None) -> DataFrame:
    """Add ``age_days``, counted back from the newest row (or a given instant)."""
    newest = clock(reference) if reference is not None else df.agg(F.max(clock(F.col(ts))).alias("m")).scalar()
    return df.withColumn("age_days", (newest - clock(F.col(ts))) / F.lit(DAY_US))


def recency_weight(df: DataFrame, half_life: float | None, ts: str = "date",
                   reference: Column | None = None, into: str = "recency_weight") -> DataFrame:
    if not half_life or half_life <= 0:
        return df.withColumn(into, F.lit(1.0))
    return with_age(df, ts, reference).withColumn(into, recency(F.col("age_days"), half_life)).drop("age_days")


def combined_weight(df: DataFrame, half_life: float | None, label: str = LABEL, ts: str = "date",
                    into: str = "weight") -> DataFrame:
    """Class weight times recency weight, divided by its mean (a scalar subquery, not a window)."""
    raw = recency_weight(class_weight(df, label, "_cw"), half_life, ts, into="_rw").withColumn(
        "_w", F.col("_cw") * F.col("_rw"))
    mean = raw.agg(F.avg("_w").alias("m")).scalar()
    return raw.withColumn(into, F.when(mean > 0, F.col("_w") / mean).otherwise(F.col("_w"))).drop("_cw", "_rw", "_w")


def effective_sample_size(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Kish: (sum w)^2 / sum w^2."""
    s, q = F.sum(weight), F.sum(F.col(weight) * F.col(weight))
    return df.agg(F.when(s > 0, s * s / q).otherwise(F.lit(0.0)).alias("effective_rows"))


def half_life_sweep(df: DataFrame, half_lives: list[int], ts: str = "date") -> DataFrame:
    """Effective sample size of the recency weights for each candidate half-life, in one pass."""
    aged = with_age(df.select(ts), ts)
    sums = []
    for h in half_lives:
        w = recency(F.col("age_days"), h if h > 0 else None)
        sums += [F.sum(w).alias(f"s{h}"), F.sum(w * w).alias(f"q{h}")]
    wide = aged.agg(*sums)
    rows = F.array(*[F.struct(F.lit(h).alias("half_life"), (F.col(f"s{h}") * F.col(f"s{h}") / F.col(f"q{h}"))
                              .alias("effective_rows")) for h in half_lives])
    return wide.select(F.inline(rows))
