"""Lookups against small fitted curves: bands, percentiles, calibration.

A curve has a fixed number of knots (101 percentiles, at most 512 calibration knots, 8 bands).
The segment of each value is found by binary search inside the row pipeline, and the knots are
literals, so no join, shuffle or nested loop is involved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def locate(df: DataFrame, edges: Sequence[float], value: str, into: str) -> DataFrame:
    """Number of edges that are <= value (0..len(edges)); NULL stays NULL."""
    splits = [-INF, *[float(e) for e in edges], INF]
    if len(edges) == 0:
        return df.withColumn(into, F.when(F.col(value).isNotNull(), F.lit(0)))
    cell = Bucketizer(splits=splits, inputCol="_value", outputCol="_cell", handleInvalid="keep")
    # NULL is parked at an ordinary number and blanked again, so that every row keeps its place.
    parked = df.withColumn("_value", F.coalesce(F.col(value).cast("double"), F.lit(float(edges[0]))))
    found = cell.transform(parked)
    return found.withColumn(into, F.when(F.col(value).isNotNull(), F.col("_cell").cast("int"))).drop("_value", "_cell")


def _pick(values: Sequence[float], index: Column) -> Column:
    return F.get(F.lit([float(v) for v in values]), index)


def interpolate(df: DataFrame, xs: Sequence[float], ys: Sequence[float], value: str, into: str) -> DataFrame:
    """Piecewise-linear lookup, clamped at both ends; where knots repeat, the last one wins."""
    left, right, grid = _corners(xs, ys)
    if not grid:
        return df.withColumn(into, F.col(value))
    placed = locate(df, grid, value, "_seg")
    return placed.withColumn(into, _on_curve(grid, left, right, ys, F.col(value), F.col("_seg"))).drop("_seg")


def _corners(xs: Sequence[float], ys: Sequence[float]) -> tuple[list[float], list[float], list[float]]:
    """(value used to its right, value used to its left, x) of every distinct x."""
    left, right = [], []
    grid: list[float] = []
    for x, y in zip(xs, ys):
        if grid and grid[-1] == x:
            left[-1] = y
        else:
            grid.append(float(x))
            left.append(y)
            right.append(y)
    return left, right, grid


def _on_curve(grid: list[float], left: list[float], right: list[float], ys: Sequence[float], v: Column, seg: Column) -> Column:
    i = seg - 1  # index of the last knot at or below the value
    x0, y0 = _pick(grid, i), _pick(left, i)
    x1, y1 = _pick(grid, i + 1), _pick(right, i + 1)
    inside = y0 + (y1 - y0) / (x1 - x0) * (v - x0)
    return (
        F.when(seg.isNull(), F.lit(None).cast("double"))
        .when(seg == 0, F.lit(float(ys[0])))
        .when((seg == len(grid)) | (v == x0), y0)
        .otherwise(inside)
    )


def percentile_of(df: DataFrame, knots: Sequence[float], value: str, into: str) -> DataFrame:
    """Share of the reference at or below a value, from evenly spaced percentile knots.

    At or below the first knot is 0, at or above the last is 1.
    """
    return percentiles_of(df, {into: (F.col(value), knots)})


def percentiles_of(df: DataFrame, curves: dict[str, tuple[Column, Sequence[float]]]) -> DataFrame:
    """:func:`percentile_of` for many columns: all values are placed by one projection each step, however many there are."""
    if not curves:
        return df
    names = list(enumerate(curves.items()))
    shares = [[i / (len(knots) - 1) for i in range(len(knots))] for _, (_, (_, knots)) in names]
    corners = [_corners(knots, share) for (_, (_, (_, knots))), share in zip(names, shares)]
    # NULL is parked at an ordinary number, as in ``locate``.
    ready = df.withColumns({f"_v{k}": v for k, (_, (v, _)) in names}
                           | {f"_value{k}": F.coalesce(v.cast("double"), F.lit(corners[k][2][0])) for k, (_, (v, _)) in names})
    cell = Bucketizer(splitsArray=[[-INF, *grid, INF] for _, _, grid in corners], handleInvalid="keep",
                      inputCols=[f"_value{k}" for k, _ in names], outputCols=[f"_cell{k}" for k, _ in names])
    placed = cell.transform(ready)

    def share(k: int, knots: Sequence[float]) -> Column:
        left, right, grid = corners[k]
        v = F.col(f"_v{k}")
        seg = F.when(v.isNotNull(), F.col(f"_cell{k}").cast("int"))
        return (F.when(v <= float(knots[0]), 0.0).when(v >= float(knots[-1]), 1.0)
                .otherwise(_on_curve(grid, left, right, shares[k], v, seg)))

    out = placed.withColumns({into: share(k, knots) for k, (into, (_, knots)) in names})
    return out.drop(*[f"{c}{k}" for k, _ in names for c in ("_v", "_value", "_cell")])


def band_of(df: DataFrame, edges: Sequence[float], value: str, into: str) -> DataFrame:
    """Index of the half-open band [edge i, edge i+1); outside every band means the last one."""
    last = len(edges) - 2
    cell = locate(df, edges, value, "_at").withColumn("_at", F.col("_at") - 1)
    return cell.withColumn(
        into, F.when((F.col("_at") < 0) | (F.col("_at") > last), F.lit(last)).otherwise(F.col("_at"))
    ).drop("_at")
