"""Joins and groupings that survive one key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.shared import materialize

# A hot key holds more than 1/SHARE of the rows, so there are fewer than SHARE hot keys.
SHARE = 500
# A lookup table is broadcast only after a count has shown it to be at most this long.
BROADCAST_ROWS = 50_000
# A list becomes part of an expression up to this length, beyond it a lookup table.
LITERALS = 1_000


class DuplicateKey(ValueError):
    """The one-side of a many-to-one join repeats a key."""


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, count) of keys that stand on several rows; a missing key is none."""
    return df.groupBy(key).count().where((F.col("count") > 1) & F.col(key).isNotNull())


def check_unique(df: DataFrame, key: str) -> None:
    repeated = repeated_keys(df, key).limit(3).collect()
    if repeated:
        raise DuplicateKey(f"{key} repeats, e.g. {[r[key] for r in repeated]}")


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True when the table holds at most ``limit`` rows; reads no more than one row past it."""
    return df.limit(limit + 1).count() <= limit


def dominant_keys(df: DataFrame, key: str, min_rows: int = 1_000_000) -> list:
    """Keys holding more than 1/SHARE of the rows (at most SHARE - 1 of them, by counting)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    heavy = counts.where((F.col("n") * SHARE > total) & (F.col("n") > min_rows) & F.col(key).isNotNull())
    return [r[key] for r in heavy.collect()]


def left_lookup(facts: DataFrame, dim: DataFrame, key: str, small: int = BROADCAST_ROWS, salts: int | None = None) -> DataFrame:
    """Many-to-one left join; ``dim`` holds one row per key. The facts are scanned once, whatever the size of ``dim``.

    A table counted to be small is broadcast. A larger one is joined by one shuffle on the key. A key with many
    facts, or the missing key, makes one large partition, which adaptive execution deals over as many tasks as its
    measured size asks for; only that partition's rows of ``dim`` are read several times.

    Adaptive execution does not split where an operator behind the join relies on its partitioning, or where it
    is switched off. For these cases ``salts`` shuffles on key and salt: facts draw a salt, and each row of ``dim``
    stands once for every salt. It defaults to this with the parallelism of the cluster if skew joins are switched off.
    """
    if is_small(dim, small):
        return facts.join(F.broadcast(dim), key, "left")
    if salts is None:
        if splits_skew(facts.sparkSession):
            return facts.join(dim, key, "left")
        salts = max(2, facts.sparkSession.sparkContext.defaultParallelism)
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in facts.columns if not _nested(facts, c))), F.lit(salts)).cast("int")
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return facts.withColumn("_salt", salt).join(copies, [key, "_salt"], "left").drop("_salt")


def splits_skew(spark: SparkSession) -> bool:
    """Whether adaptive execution deals a large partition of a join over several tasks."""
    on = lambda name: spark.conf.get(f"spark.sql.adaptive.{name}", "true") == "true"
    return on("enabled") and on("skewJoin.enabled")


def _nested(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("map", "variant")


def inner_lookup(facts: DataFrame, lookup: DataFrame, keys: list[str], hot_rows: int = 1_000_000) -> DataFrame:
    """Many-to-one inner join that survives hot keys.

    Keys with more than ``hot_rows`` facts are joined by broadcast when a count shows them to be
    few; the others are joined by shuffle. Without such keys ``lookup`` is computed in the join itself, where
    its partitioning is of use; else it is written once, as two joins read it.
    """
    hot = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_facts")).where(F.col("_facts") > hot_rows).select(*keys)
    if hot.isEmpty():
        return facts.join(lookup, keys)
    hot = materialize(hot)
    if not is_small(hot):
        return facts.join(lookup, keys)
    lookup, hot = materialize(lookup), F.broadcast(hot)
    return facts.join(F.broadcast(lookup.join(hot, keys, "left_semi")), keys).unionByName(
        facts.join(hot, keys, "left_anti").join(lookup.join(hot, keys, "left_anti"), keys))


def crowded_keys(df: DataFrame, key: str, limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows, as a table: their number grows with the data."""
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > limit).select(key)
    )
