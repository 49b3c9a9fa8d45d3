"""Additive contribution of each feature to one row's score.

Linear member: coefficient times distance from the mean, in log-odds. Tree members: Shapley
values of the path-dependent tree game, exact for the ensemble, evaluated on Arrow batches with
the (small) node table shipped to the tasks. A feature and its missing flag are one player.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.plans import boosting
from riskloom.plans.modelling import Fitted, feature_slots, model_inputs
from riskloom.schema import FEATURES
from riskloom.sources.shared import delete, scratch


def with_contributions(fitted: Fitted, df: DataFrame, train: DataFrame | None = None,
                       prefix: str = "_contrib_") -> DataFrame:
    """Add ``<prefix><feature>`` for every feature. The linear member measures from the means of ``train``, or of the rows it was fitted on."""
    if fitted.name == "gbt":
        rows = df.select(*df.columns, boosting.bins_udf(fitted.model.binning)(*boosting.raw_inputs()).alias("_v"))
        return _named(rows.withColumn("_phi", _tree_udf(fitted, df.sparkSession)(F.col("_v"))), df, prefix)
    head = fitted.model
    vectors = model_inputs(df, fitted.name, fitted.levels)
    for stage in head.stages[:-1]:
        vectors = stage.transform(vectors)
    rows = vectors.select(*df.columns, vector_to_array("features").alias("_v"))
    if fitted.name == "linear":
        out = _linear(fitted, rows, train)
    else:
        out = rows.withColumn("_phi", _tree_udf(fitted, df.sparkSession)(F.col("_v")))
    return _named(out, df, prefix)


def _named(out: DataFrame, df: DataFrame, prefix: str) -> DataFrame:
    return out.select(*df.columns, *[F.col("_phi")[i].alias(f"{prefix}{f}") for i, f in enumerate(FEATURES)])


def _linear(fitted: Fitted, rows: DataFrame, train: DataFrame | None) -> DataFrame:
    if train is None:
        mean = fitted.info["means"]
    else:
        vectors = model_inputs(train, fitted.name, fitted.levels)
        for stage in fitted.model.stages[:-1]:
            vectors = stage.transform(vectors)
        mean = vectors.agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
    coef = fitted.model.stages[-1].coefficients.toArray()
    owner = feature_slots(fitted.levels, one_hot=True)
    parts = []
    for f in range(len(FEATURES)):
        slots = [i for i, o in enumerate(owner) if o == f]
        terms = [F.lit(float(coef[i])) * (F.col("_v")[i] - F.lit(float(mean[i]))) for i in slots if coef[i] != 0.0]
        parts.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    return rows.withColumn("_phi", F.array(*parts))


def read_leaves(fitted: Fitted, spark) -> list[tuple[float, list[tuple]]]:
    """Every leaf as (value, path); a path step is (slot, threshold, left categories, goes left, cover share). Read once for each member."""
    if fitted.leaves is None:
        fitted.leaves = fitted.model.leaves() if fitted.name == "gbt" else _forest_leaves(fitted, spark)
    return fitted.leaves


def _forest_leaves(fitted: Fitted, spark) -> list[tuple[float, list[tuple]]]:
    path = scratch(spark, "trees")
    fitted.model.stages[-1].write().overwrite().save(path)
    nodes: dict[int, dict] = {}
    for r in spark.read.parquet(f"{path}/data").collect():  # numTrees x nodes per tree: set by the parameters
        nodes.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    delete(spark, path)
    leaves = []
    for table in nodes.values():
        cover = lambda n: sum(n["impurityStats"])
        stack = [(table[0], [])]
        while stack:
            node, steps = stack.pop()
            if node["leftChild"] < 0:
                leaves.append((node["impurityStats"][1] / max(cover(node), 1e-12) / len(nodes), steps))  # mean leaf probability
                continue
            split = node["split"]
            cats = split["leftCategoriesOrThreshold"]
            categorical = split["numCategories"] >= 0
            for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
                share = cover(table[child]) / max(cover(node), 1e-12)
                stack.append((table[child], [*steps, (
                    split["featureIndex"], None if categorical else cats[0],
                    list(cats) if categorical else None, left, share)]))
    return leaves


def _patterns(share: np.ndarray) -> np.ndarray:
    """Shapley weights of leaves with as many players each: for leaf, player and pattern of the conditions a row meets (a bit
    for each player). Summing over coalitions of equal size is a product of (share + follows * t) per player, so no subset is enumerated."""
    leaves, m = share.shape
    follows = (np.arange(1 << m) >> np.arange(m)[:, None] & 1).astype(float)
    out = np.empty((leaves, m, 1 << m))
    for p in range(m):
        poly = [np.ones((leaves, 1 << m))]
        for q in range(m):
            if q == p:
                continue
            longer = [share[:, q, None] * c for c in poly] + [np.zeros((leaves, 1 << m))]
            for s, c in enumerate(poly):
                longer[s + 1] = longer[s + 1] + follows[q] * c
            poly = longer
        weight = sum(c * (factorial(s) * factorial(m - s - 1) / factorial(m)) for s, c in enumerate(poly))
        out[:, p] = (follows[p] - share[:, p, None]) * weight
    return out


def shapley(x: np.ndarray, leaves: list, owner: list[int], n_features: int) -> np.ndarray:
    """Shapley values for rows of ``x``. What a leaf gives to its players depends only on which of its conditions a row meets,
    so it is worked out once for each such pattern and looked up by row."""
    phi = np.zeros((n_features, len(x)))
    columns = np.ascontiguousarray(x.T)
    small = {}  # columns of small whole numbers, as places in a table
    for slot, column in enumerate(columns):
        places = np.where((column >= 0) & (column < 1024), column, 0).astype(np.intp)
        if (places == column).all():
            small[slot] = places
    alike: dict[int, list] = {}
    for value, steps in leaves:
        share: dict[int, float] = {}
        for step in steps:
            share[owner[step[0]]] = share.get(owner[step[0]], 1.0) * step[4]
        alike.setdefault(len(share), []).append((value, steps, share))
    for m, group in alike.items():
        if not m:
            continue
        chunk = max(1, (1 << 17) >> m)
        for at in range(0, len(group), chunk):
            some = group[at:at + chunk]
            tables = _patterns(np.array([list(share.values()) for _, _, share in some]))
            for (value, steps, share), table in zip(some, tables):
                pattern = _pattern(columns, small, steps, owner, list(share))
                for p, t in zip(share, value * table):
                    phi[p] += t[pattern]
    return phi.T


def _pattern(columns: np.ndarray, small: dict[int, np.ndarray], steps: list, owner: list[int], players: list[int]) -> np.ndarray:
    """A bit for each player whose conditions a row meets."""
    bits = np.zeros(columns.shape[1], np.intp)
    for i, p in enumerate(players):
        mine = [step for step in steps if owner[step[0]] == p]
        slots = {step[0] for step in mine}
        if len(slots) == 1 and mine[0][0] in small and all(step[2] is not None for step in mine):
            table = np.full(1024, 1 << i, np.intp)
            for _, _, cats, left, _ in mine:
                listed = np.zeros(1024, bool)
                inside = np.asarray([c for c in cats if c == int(c) and 0 <= c < 1024], np.intp)
                listed[inside] = True
                table[listed != left] = 0
            bits |= table[small[mine[0][0]]]
            continue
        ok = np.ones(columns.shape[1], bool)
        for slot, threshold, cats, left, _ in mine:
            goes_left = columns[slot] <= threshold if cats is None else np.isin(columns[slot], cats)
            ok &= goes_left if left else ~goes_left
        bits |= ok.astype(np.intp) << i
    return bits


def _tree_udf(fitted: Fitted, spark):
    leaves = read_leaves(fitted, spark)
    owner = list(range(len(FEATURES))) if fitted.name == "gbt" else feature_slots(fitted.levels, one_hot=False)
    n = len(FEATURES)

    @F.pandas_udf("array<double>")
    def contributions(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(shapley(np.vstack(v.to_numpy()), leaves, owner, n)))

    return contributions
