"""Ordered computations that never sort the whole input in one task.

An unpartitioned window is only ever applied to a table whose size is fixed by the number
format, not by the data. Rows reach that point in three steps:

1. equal values are merged (map-side combine), so a value held by a third of all rows is one row;
2. values are mapped by a monotone key to fine bins (2**20 per octave) and coarse bins
   (256 per octave), and running totals are formed over bins;
3. only inside one fine bin are distinct values sorted.

All bin edges are constants, so a recomputed task lands on exactly the same bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.sources.shared import materialize

BINS_PER_OCTAVE = 1 << 20
COARSE_SHIFT = 12


def order_key(value: Column) -> Column:
    """Monotone bigint key of a double: sign times a fine logarithmic bin."""
    size = F.abs(value)
    magnitude = (
        F.floor((F.log2(F.when(size > 0, size)) + F.lit(1080.0)) * F.lit(float(BINS_PER_OCTAVE))) + F.lit(1)
    ).cast("bigint")
    return F.when(value > 0, magnitude).when(value < 0, -magnitude).otherwise(F.lit(0)).cast("bigint")


def _coarse_bins(keyed: DataFrame, by: list[str], sums: list[str], descending: bool) -> DataFrame:
    """Per coarse bin: its totals, the totals ahead of it and the group's totals.

    A group has at most a few hundred thousand coarse bins by the range of a double, typically
    a few thousand, so this window is bounded even without a partition key.
    """
    coarse = keyed.groupBy(*by, "_coarse").agg(*[F.sum(s).alias(s) for s in sums])
    group = Window.partitionBy(*by)
    ordered = group.orderBy(F.desc("_coarse") if descending else F.asc("_coarse"))
    return coarse.select(
        *by, "_coarse",
        *[F.col(s).alias(f"_bin_{s}") for s in sums],
        *[(F.sum(s).over(ordered) - F.col(s)).alias(f"_ahead_{s}") for s in sums],
        *[F.sum(s).over(group).alias(f"_all_{s}") for s in sums],
    )


def _fine_bins(keyed: DataFrame, coarse: DataFrame, by: list[str], sums: list[str], descending: bool) -> DataFrame:
    """Per fine bin: its totals and the totals of every bin ahead of it, plus the columns of ``coarse``."""
    fine = keyed.groupBy(*by, "_coarse", "_fine").agg(*[F.sum(s).alias(s) for s in sums])
    inner = Window.partitionBy(*by, "_coarse").orderBy(F.desc("_fine") if descending else F.asc("_fine"))
    within = fine.select(*by, "_coarse", "_fine", *sums,
                         *[(F.sum(s).over(inner) - F.col(s)).alias(f"_before_{s}") for s in sums])
    extra = [c for c in coarse.columns if c not in (*by, "_coarse") and not c.startswith(("_bin_", "_ahead_"))]
    return within.join(coarse.drop(*[f"_bin_{s}" for s in sums]), [*by, "_coarse"]).select(
        *by, "_coarse", "_fine", *extra,
        *[F.col(s).alias(f"_bin_{s}") for s in sums],
        *[(F.col(f"_before_{s}") + F.col(f"_ahead_{s}")).alias(f"_offset_{s}") for s in sums],
    )


def with_keys(df: DataFrame, value: str) -> DataFrame:
    keyed = df.withColumn("_fine", order_key(F.col(value)))
    return keyed.withColumn("_coarse", F.shiftright("_fine", COARSE_SHIFT))


def running_totals(df: DataFrame, value: str, sums: list[str], by: Sequence[str] = (),
                   descending: bool = False) -> DataFrame:
    """Add ``cum_<s>``: the inclusive running total of each sum in value order.

    ``df`` holds one row per (by, value). It is read three times, so it is written out first.
    """
    by = list(by)
    keyed = materialize(with_keys(df, value))
    offsets = _fine_bins(keyed, _coarse_bins(keyed, by, sums, descending), by, sums, descending)
    window = Window.partitionBy(*by, "_fine").orderBy(F.desc(value) if descending else F.asc(value))
    joined = keyed.join(offsets.drop("_coarse"), [*by, "_fine"])
    return joined.select(
        *df.columns,
        *[(F.sum(s).over(window) + F.col(f"_offset_{s}")).alias(f"cum_{s}") for s in sums],
    )


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles per group: (by..., q, value).

    NULL and NaN are left out. Only the fine bins that hold a wanted rank are sorted, so the
    work after the first aggregation does not depend on how the rows spread over groups.
    """
    by = list(by)
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = (
        known.select(*by, F.col(value).cast("double").alias("_v"))
        .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    )
    keyed = materialize(with_keys(counts, "_v"))
    # Both neighbours of every wanted position travel down to the one bin that holds them.
    pos = lambda p: p * (F.col("_all__n") - 1)
    ends = F.flatten(F.transform(F.lit([float(p) for p in probs]), lambda p: F.array(
        F.struct(p.alias("q"), pos(p).alias("pos"), F.floor(pos(p)).alias("rank")),
        F.struct(p.alias("q"), pos(p).alias("pos"), F.ceil(pos(p)).alias("rank")))))
    inside = lambda items, first, n: F.filter(items, lambda w: (w["rank"] >= first) & (w["rank"] < first + n))
    held = F.size("_wanted") > 0
    coarse = _coarse_bins(keyed, by, ["_n"], descending=False).withColumn(
        "_wanted", inside(ends, F.col("_ahead__n"), F.col("_bin__n"))).where(held)
    bins = _fine_bins(keyed, coarse, by, ["_n"], descending=False).withColumn(
        "_wanted", inside(F.col("_wanted"), F.col("_offset__n"), F.col("_bin__n"))).where(held)
    bins = bins.select(*by, "_fine", "_offset__n", "_wanted")
    window = Window.partitionBy(*by, "_fine").orderBy("_v")
    first = F.sum("_n").over(window) - F.col("_n") + F.col("_offset__n")
    found = (
        keyed.join(bins, [*by, "_fine"]).withColumn("_first", first)
        .select(*by, "_v", F.explode(inside(F.col("_wanted"), F.col("_first"), F.col("_n"))).alias("w"))
    )
    pair = found.groupBy(*by, F.col("w.q").alias("q"), F.col("w.pos").alias("_pos")).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    frac = F.col("_pos") - F.floor("_pos")
    return pair.select(*by, "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias("value"))


def quantile_list(df: DataFrame, value: str, probs: Sequence[float]) -> list[float]:
    """Exact quantiles of one column as Python floats, in ``probs`` order (bounded by it)."""
    found = {r["q"]: r["value"] for r in exact_quantiles(df, value, sorted(set(probs))).collect()}
    return [found[float(p)] for p in probs if float(p) in found]


#: Microseconds of a day, a second and a microsecond: the digits of the clock.
_UNITS = (86_400_000_000, 1_000_000, 1)


def rank_cuts(df: DataFrame, ts_us: Column, key: Column, ranks: Sequence[int],
              small: int = 1_000_000, instant: Column | None = None) -> list[tuple[int, int] | None]:
    """The (clock, key) found at each 0-based rank of the order (clock, key).

    Histogram descent: day, second, microsecond, then 16-bit digits of the key. Each pass is a
    filtered count, and a bin is opened only while more than ``small`` rows share it, so rows
    are never sorted globally. ``key`` must be a non-negative bigint. ``instant`` is the timestamp behind the clock:
    passes after the first then read only row groups that reach into an open slot.
    """
    base = df.select(ts_us.cast("bigint").alias("_t"), key.cast("bigint").alias("_k"),
                     *([] if instant is None else [instant.alias("_i")]))
    us_day, us_sec, _ = _UNITS
    digits = [
        F.floor(F.col("_t") / F.lit(us_day)).cast("bigint"),
        F.floor(F.pmod("_t", F.lit(us_day)) / F.lit(us_sec)).cast("bigint"),
        F.pmod("_t", F.lit(us_sec)),
        *[F.shiftright("_k", s).bitwiseAND(F.lit(0xFFFF)) for s in (48, 32, 16, 0)],
    ]
    answer: dict[int, tuple[int, int] | None] = {r: None for r in ranks}
    # One open slot per wanted rank: (path so far, rank inside the path).
    open_slots: dict[int, tuple[tuple[int, ...], int, int]] = {r: ((), r, -1) for r in answer}
    depth = 0
    while open_slots:
        paths = {path for path, _, _ in open_slots.values()}
        scope = _in_paths(base, digits, paths)
        prefix = [d.alias(f"_d{i}") for i, d in enumerate(digits[:depth])]
        names = [f"_d{i}" for i in range(depth)]
        binned = scope.select(*prefix, digits[depth].alias("_digit")).groupBy(*names, "_digit").agg(
            F.count(F.lit(1)).alias("_n"))
        window = Window.partitionBy(*names).orderBy("_digit")
        placed = binned.withColumn("_first", F.sum("_n").over(window) - F.col("_n"))
        hit = F.lit(False)
        for path, rank, _ in open_slots.values():
            here = (F.lit(rank) >= F.col("_first")) & (F.lit(rank) < F.col("_first") + F.col("_n"))
            for name, d in zip(names, path):
                here = here & (F.col(name) == F.lit(d))
            hit = hit | here
        rows = placed.where(hit).collect()  # at most one row per wanted rank
        depth += 1
        still: dict[int, tuple[tuple[int, ...], int, int]] = {}
        for wanted, (path, rank, _) in open_slots.items():
            for r in rows:
                if all(r[n] == d for n, d in zip(names, path)) and r["_first"] <= rank < r["_first"] + r["_n"]:
                    still[wanted] = ((*path, r["_digit"]), rank - r["_first"], r["_n"])
        small_slots = {w: s for w, s in still.items() if s[2] <= small or depth == len(digits)}
        if small_slots:
            slots = {s[0] for s in small_slots.values()}
            names = [f"_d{i}" for i in range(depth)]
            scope = _in_paths(base, digits, slots)
            order = Window.partitionBy(*names).orderBy("_t", "_k")
            ranked = scope.select("_t", "_k", *[d.alias(n) for d, n in zip(digits, names)]).withColumn(
                "_r", F.row_number().over(order) - 1)
            hit = F.lit(False)
            for path, rank, _ in small_slots.values():
                here = F.col("_r") == F.lit(rank)
                for name, d in zip(names, path):
                    here = here & (F.col(name) == F.lit(d))
                hit = hit | here
            for r in ranked.where(hit).collect():
                for w, (path, rank, _) in small_slots.items():
                    if rank == r["_r"] and all(r[n] == d for n, d in zip(names, path)):
                        answer[w] = (r["_t"], r["_k"])
        open_slots = {w: s for w, s in still.items() if w not in small_slots}
    return [answer[r] for r in ranks]


def _in_paths(base: DataFrame, digits: list[Column], paths: set[tuple[int, ...]]) -> DataFrame:
    if paths == {()}:
        return base
    keep, spans = F.lit(False), F.lit(False)
    for path in paths:
        here = F.lit(True)
        for digit, d in zip(digits, path):
            here = here & (digit == F.lit(d))
        keep = keep | here
        first = sum(d * unit for d, unit in zip(path, _UNITS))
        last = first + _UNITS[min(len(path), len(_UNITS)) - 1]
        if "_i" in base.columns:
            spans = spans | ((F.col("_i") >= F.timestamp_micros(F.lit(first))) & (F.col("_i") < F.timestamp_micros(F.lit(last))))
        else:
            spans = spans | ((F.col("_t") >= F.lit(first)) & (F.col("_t") < F.lit(last)))
    # The spans stand alone, as plain ranges of one column: only so do they reach the scan's statistics.
    return base.where(spans).where(keep)


def hash_text(key: Column, seed: int) -> Column:
    """Reproducible pseudo-random text for a key, the same on any engine with md5."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def lowest_by_hash(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Keep exactly the ``k`` rows whose hash of ``key`` is lowest (ties broken by key).

    The threshold bin comes from a 65,536-bin histogram; only rows of that single bin, a
    1/65,536 share of a uniform hash, are ranked.
    """
    if k <= 0:
        return df.limit(0)
    hashed = df.withColumn("_h", hash_text(F.col(key), seed))
    hashed = hashed.withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    bins = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    first = F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")
    edge = (
        bins.withColumn("_first", first)
        .where((F.col("_first") < k) & (F.col("_first") + F.col("_n") >= k))
        .collect()
    )
    if not edge:
        return df
    cut, need = edge[0]["_b"], k - edge[0]["_first"]
    below = hashed.where(F.col("_b") < cut)
    ranked = (
        hashed.where(F.col("_b") == cut)
        .withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
        .where(F.col("_r") <= need).drop("_r")
    )
    return below.unionByName(ranked).drop("_h", "_b")
