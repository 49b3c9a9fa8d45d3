"""Time-ordered splits, the checks that they do not leak, and class-aware samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.features import clock
from riskloom.operators.ordering import lowest_by_hash, rank_cuts
from riskloom.schema import LABEL

# The share of the timeline in each split; the last one takes the remainder.
SPLIT_FRACTIONS = {"train": 0.82, "val": 0.08, "test": 0.09, "demo": 0.01}
VAL_FIT_FRACTION = 0.60


class Leakage(AssertionError):
    """A split shares an id with another, or reaches into a later one."""


def by_time(df: DataFrame, fractions: dict[str, float], ts: str = "date", key: str = "id",
            into: str = "split", source: DataFrame | None = None) -> DataFrame:
    """Label each row by its place on the timeline: the first ``int(n * fraction)`` rows get the
    first name and so on; ties on the timestamp fall back to the key.

    Only the boundary rows are searched for. Labelling is then a comparison with constants: no
    row moves, whatever the size of a single day. ``source`` names a cheaper frame with the same
    rows (say, the table before joins and windows) to search in.
    """
    names = list(fractions)
    base = df if source is None else source
    n, timed = base.agg(F.count(F.lit(1)), F.count(F.col(ts))).first()
    if timed < n:
        raise ValueError(f"{n - timed} rows have no {ts}: they belong to no split")
    ends, start = [], 0
    for name in names[:-1]:
        start += int(n * fractions[name])
        ends.append(start)
    us, k = clock(F.col(ts)), F.col(key)
    instant = F.col(ts) if base.schema[ts].dataType.typeName() == "timestamp" else None
    cuts = rank_cuts(base, us, k, [e for e in sorted(set(ends)) if e < n], instant=instant)
    found = dict(zip([e for e in sorted(set(ends)) if e < n], cuts))
    label = F.lit(names[-1])
    for name, end in reversed(list(zip(names[:-1], ends))):
        if end >= n:
            label = F.lit(name)
        else:
            cut_us, cut_key = found[end]
            ahead = (us < cut_us) | ((us == cut_us) & (k < cut_key))
            label = F.when(ahead, F.lit(name)).otherwise(label)
    return df.withColumn(into, label)


def time_split(df: DataFrame, ts: str = "date", key: str = "id", source: DataFrame | None = None) -> DataFrame:
    return by_time(df, SPLIT_FRACTIONS, ts, key, source=source)


def val_cut(df: DataFrame, ts: str = "date", key: str = "id") -> DataFrame:
    """Refine ``split = 'val'`` into ``val_fit`` and the later ``val_sel``."""
    val = by_time(df.where(F.col("split") == "val"),
                  {"val_fit": VAL_FIT_FRACTION, "val_sel": 1 - VAL_FIT_FRACTION}, ts, key, into="split")
    return df.where(F.col("split") != "val").unionByName(val)


def split_summary(df: DataFrame, ts: str = "date") -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(LABEL).cast("bigint").alias("fraud"),
        F.avg(LABEL).alias("fraud_rate"),
        F.min(ts).alias("start"),
        F.max(ts).alias("end"),
    )


def leakage_report(df: DataFrame, order: tuple[str, ...] = ("train", "val", "test"),
                   ts: str = "date", key: str = "id") -> DataFrame:
    """One row: ids in two splits, repeated ids, and boundaries where time runs backwards."""
    per_id = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"),
                                 F.min("split").alias("a"), F.max("split").alias("b"))
    ids = per_id.agg(
        F.sum((F.col("a") != F.col("b")).cast("bigint")).alias("shared_ids"),
        F.sum((F.col("n") > 1).cast("bigint")).alias("repeated_ids"),
        F.sum("n").cast("bigint").alias("rows"),
        F.count(F.lit(1)).alias("distinct_ids"),
    )
    us = clock(F.col(ts))
    spans = df.agg(*[f(F.when(F.col("split") == s, us)).alias(f"{s}_{tag}")
                     for s in order for f, tag in ((F.min, "lo"), (F.max, "hi"))])
    backwards = [F.coalesce((F.col(f"{a}_hi") > F.col(f"{b}_lo")).cast("int"), F.lit(0))
                 for a, b in zip(order[:-1], order[1:])]
    ordered = spans.select(sum(backwards, F.lit(0)).alias("x")).scalar()
    return ids.withColumn("backward_boundaries", ordered.cast("int"))


def assert_no_leakage(df: DataFrame, ts: str = "date", key: str = "id") -> None:
    r = leakage_report(df, ts=ts, key=key).first()
    if r["shared_ids"] or r["repeated_ids"]:
        raise Leakage(f"{r['shared_ids']} ids in two splits, {r['repeated_ids']} ids repeated")
    if r["backward_boundaries"]:
        raise Leakage("a split extends past the start of the next one")


def split_overlap(df: DataFrame, key: str = "id") -> DataFrame:
    """Ids shared by each pair of splits (empty when the split is clean)."""
    per_id = df.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(
        F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return (
        per_id.select(F.explode(pairs).alias("p"))
        .groupBy(F.col("p.a").alias("left_split"), F.col("p.b").alias("right_split"))
        .agg(F.count(F.lit(1)).alias("shared_ids"))
    )


def _half_even(x: float) -> int:
    return int(round(x))


def subsample(df: DataFrame, frac: float, seed: int = 42, keep_all_positives: bool = True,
              key: str = "id", label: str = LABEL) -> DataFrame:
    """Every positive plus exactly ``max(round(frac * negatives), 1)`` negatives.

    ``keep_all_positives=False`` thins the positives by the same rule.
    """
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    pos, neg = df.where(F.col(label) == 1), df.where(F.col(label) == 0)
    if not keep_all_positives:
        pos = lowest_by_hash(pos, key, max(_half_even(n.get(1, 0) * frac), 1), seed)
    return pos.unionByName(lowest_by_hash(neg, key, max(_half_even(n.get(0, 0) * frac), 1), seed))


def thin_negatives(df: DataFrame, keep_frac: float, seed: int = 42,
                   key: str = "id", label: str = LABEL) -> DataFrame:
    """Every positive plus ``int(keep_frac * negatives)`` negatives."""
    neg = df.where(F.col(label) == 0)
    return df.where(F.col(label) == 1).unionByName(
        lowest_by_hash(neg, key, int(neg.count() * keep_frac), seed))


def draw_one(df: DataFrame, condition: Column, seed: int = 42, key: str = "id") -> DataFrame:
    """One pseudo-random row among those that meet the condition (a top-1, not a sort)."""
    from riskloom.operators.ordering import hash_text

    return df.where(condition).orderBy(hash_text(F.col(key), seed), key).limit(1)
