"""A quality classifier of sparse rules (rule ensemble with a lasso).

Shallow trees grown on statistics of labelled texts give paths; each path is a rule, a conjunction of
comparisons. A logistic regression with an L1 penalty keeps few of the rules, and those are compiled into
one Spark column over the statistics, which scores all documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm import blocks, stats
from riskloom.sources import shared

TRAIN_ROWS = 20_000  # labelled rows used at most: those whose id has the least hash
TREES, DEPTH = 40, 3
PENALTY = 0.0005
SLICE_BYTES = 2 << 20  # text measured at once in a task

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, is it at most, threshold) for each comparison


def _count_of(name: str) -> Column:
    return F.col(f"_c._{name}")


def _ratio(a: str, b: str) -> Column:
    return F.when(_count_of(b) > 0, _count_of(a) / _count_of(b)).otherwise(0.0)


#: Statistics that rules compare.
STATISTICS: dict[str, Callable[[], Column]] = {
    "words": lambda: F.log1p(_count_of("n_words").cast("double")),
    "word_length": lambda: _ratio("word_chars", "n_words"),
    "symbols": lambda: _ratio("n_symbols", "n_words"),
    "dup_lines": lambda: _ratio("n_dup_lines", "n_lines"),
    "repeats": lambda: _ratio("n_repeat_words", "n_words"),
    "upper": lambda: _ratio("n_upper", "n_letters"),
    "digits": lambda: _ratio("n_digits", "n_chars_all"),
    "marks": lambda: _ratio("n_marks", "n_words"),
    "sentences": lambda: _ratio("n_sentence", "n_words"),
    "bangs": lambda: _ratio("n_bang", "n_words"),
    "line_words": lambda: _ratio("n_words", "n_lines"),
    "distinct": lambda: _ratio("n_distinct", "n_words"),
    "bare": lambda: _ratio("n_bare", "n_words"),
    "longest": lambda: F.log1p(_count_of("longest_word").cast("double")),
}
COUNTS = T.StructType([T.StructField(f"_{c}", T.LongType()) for c in stats.NAMES])


def _count(column: pa.Array) -> list[pa.Array]:
    made = stats.counts(column)[0]
    return [pa.array(made[c], pa.int64()) for c in stats.NAMES]


def measure(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and a struct ``_s`` of the statistics of every whole text."""
    # The text goes through the workers once; the other columns go in a struct, so that no name clashes.
    rest = F.struct(*([f"`{c}`" for c in keep if c != text] or [F.lit(0).alias("none")]))
    row = df.select(rest.alias("_row"), F.col(f"`{text}`").alias("_text"))
    made = blocks.map_text(row, "_text", COUNTS, _count, ["_row", *["_text"] * (text in keep)], limit=SLICE_BYTES, after=blocks.tidy).withColumn("_c", F.struct(*COUNTS.names))
    columns = [(F.col("_text") if c == text else F.col(f"_row.`{c}`")).alias(c) for c in keep]
    return made.select(*columns, F.struct(*(f().alias(n) for n, f in STATISTICS.items())).alias("_s"))


def paths(forest) -> list[Rule]:
    """Every path from a root to another node, as the tightest comparisons on it."""
    names, found = list(STATISTICS), {}

    def walk(node, bounds: dict[tuple[str, bool], float]) -> None:
        if bounds:
            found[tuple((n, low, t) for (n, low), t in sorted(bounds.items()))] = None
        if node.numDescendants() == 0:
            return
        name, cut = names[node.split().featureIndex()], float(node.split().threshold())
        left, right = (name, True), (name, False)
        walk(node.leftChild(), bounds | {left: min(cut, bounds.get(left, math.inf))})
        walk(node.rightChild(), bounds | {right: max(cut, bounds.get(right, -math.inf))})

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


def condition(rule: Rule, at: str = "_s") -> Column:
    return reduce(Column.__and__, (F.col(f"{at}.{n}") <= t if low else F.col(f"{at}.{n}") > t for n, low, t in rule))


def fit(rows: DataFrame, label: str) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules from ``_s`` and a 0/1 label. One class only gives a constant, no rows give 0."""
    rows = shared.materialize(rows.select(F.col(label).cast("double").alias("label"), "_s").coalesce(1))  # bounded by TRAIN_ROWS
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        return (0.0 if not n else 5.0 if ones else -5.0), []
    flat = rows.select("label", *(F.col(f"_s.{c}").alias(c) for c in STATISTICS))
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(flat)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7, maxBins=64,
                                    featureSubsetStrategy="onethird", subsamplingRate=0.7).fit(vectors)
    rules = paths(forest)
    if not rules:
        return math.log(ones / (n - ones)), []
    flags = shared.materialize(rows.select("label", *(condition(r).cast("double").alias(f"r{k}") for k, r in enumerate(rules))))
    matrix = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="x").transform(flags)
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=PENALTY, maxIter=60).fit(matrix)
    weights = lasso.coefficients.toArray().tolist()
    return float(lasso.intercept), [(r, w) for r, w in zip(rules, weights) if w]


def compile_score(intercept: float, rules: list[tuple[Rule, float]], at: str = "_s") -> Column:
    total = reduce(Column.__add__, (F.when(condition(r, at), w).otherwise(0.0) for r, w in rules), F.lit(intercept))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def classify(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", score: str = "score",
             usable: Column | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Append ``score`` (0 to 1) to every row of ``df``, learnt from the labelled rows that ``usable`` admits.

    Training takes at most ``train_rows`` rows, those whose key has the least hash. Null and empty texts have all
    statistics 0 and are scored by them. Null labels and null keys do not train; repeated rows score alike.
    A column named like ``score`` is replaced.
    """
    kept = [c for c in df.columns if c != score]
    measured = shared.materialize(measure(df.select(*(f"`{c}`" for c in kept)), text, kept))
    known = labels.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").alias("_label")).where("_label IN (0, 1)")
    if usable is not None:
        known = known.where(usable)
    chosen = known.groupBy("_key").agg(F.max("_label").alias("_label"))
    chosen = blocks.lowest(chosen, "_key", train_rows, chosen.count())
    slim = measured.select(F.col(f"`{key}`").alias("_key"), "_s")
    with shared.scope(df.sparkSession):
        intercept, rules = fit(slim.join(chosen, "_key").select("_label", "_s"), "_label")
    return measured.withColumn(score, compile_score(intercept, rules)).drop("_s")
