"""The main text of web pages: gradient-boosted trees over nodes of the page, decoded top down and bottom up.

A node is open if it holds main text. Trees score every element and every text block from its features; the
decoder then takes the best choice of all that is free of contradictions: below a closed element
nothing is open, and an open element has something open below it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm import blocks, dom, sitepages
from riskloom.sources import shared

PAGES = 1_000  # annotated pages to learn from
TREES, DEPTH, STEP = 30, 5, 0.3
#: Html handled at once in a task.
SLICE_BYTES = 1 << 20

Model = tuple[dict[str, float], tuple[np.ndarray, ...]]


def annotated(numbers: list[int], layout: str | None = None) -> tuple[dom.Forest, np.ndarray]:
    """Trees of generated pages, and which nodes hold main text."""
    forest = dom.Forest()
    for k in numbers:
        forest.add(sitepages.Page(k, layout).html())
    main = np.array([t is not None and t.startswith(sitepages.MARK) for t in forest.text], bool)
    forest.text = [t and t.replace(sitepages.MARK, "").strip() for t in forest.text]
    return forest, dom.subtree(main, np.array(forest.end)) > 0


def names_of(forest: dom.Forest, k: int) -> set[str]:
    return {f"<{forest.tag[k]}>", *forest.tokens[k]}


def learn_names(spark: SparkSession, pages: int) -> dict[str, float]:
    """How much likelier elements of a tag, or with a word in their attributes, hold main text, as log odds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forest, main = annotated(batch.column("id").to_pylist())
            rows = [(name, bool(m)) for k, m in enumerate(main) if forest.text[k] is None for name in sorted(names_of(forest, k))]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.string()), pa.array([m for _, m in rows], pa.bool_())], names=["name", "main"])

    seen = spark.range(0, pages, 1, 8).mapInArrow(run, "name string, main boolean")
    seen = seen.groupBy("name").agg(F.count_if("main").alias("main"), F.count_if(~F.col("main")).alias("rest"))
    # Names that a few pages only use are of no help; what is left is bounded by the generator's names.
    return {r.name: max(-4.0, min(4.0, math.log((r.main + 1) / (r.rest + 1)))) for r in seen.where("main + rest >= 5").collect()}


def flat(trees: list, weights: list[float]) -> tuple[np.ndarray, ...]:
    """All trees as arrays: feature, threshold, left, right and value of nodes, and each tree's root. Leaves lead to themselves."""
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def walk(node, weight: float) -> int:
        at = len(feature)
        for column, v in ((feature, 0), (cut, 0.0), (left, at), (right, at), (value, weight * node.prediction())):
            column.append(v)
        if node.numDescendants():
            feature[at], cut[at] = node.split().featureIndex(), node.split().threshold()
            left[at], right[at] = walk(node.leftChild(), weight), walk(node.rightChild(), weight)
        return at

    for tree, weight in zip(trees, weights):
        roots.append(walk(tree._call_java("rootNode"), weight))
    return tuple(np.array(c) for c in (feature, cut, left, right, value, roots))


def fit(spark: SparkSession, pages: int = PAGES, trees: int = TREES, depth: int = DEPTH) -> Model:
    """Names' scores and trees, learnt from ``pages`` generated pages (rows grow with that parameter only)."""
    known = learn_names(spark, pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forest, main = annotated(batch.column("id").to_pylist())
            x = dom.features(forest, known)
            keep = dom.subtree(np.array([t is not None for t in forest.text]), np.array(forest.end)) > 0
            x, main = x[keep], main[keep]
            yield pa.RecordBatch.from_arrays([blocks.lists(x.ravel(), np.arange(len(x) + 1) * x.shape[1], pa.float64()), pa.array(main.astype(np.float64)),
                                              pa.array(1.0 + x[:, dom.FEATURES.index("words")])], names=["x", "label", "weight"])

    with shared.scope(spark):
        rows = shared.materialize(spark.range(0, pages, 1, 8).mapInArrow(run, "x array<double>, label double, weight double"))
        rows = rows.select(array_to_vector("x").alias("x"), "label", "weight")
        model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=STEP, maxBins=32, seed=7, subsamplingRate=0.7,
                              featureSubsetStrategy="0.5").fit(rows)
    return known, flat(model.trees, model.treeWeights)


def margins(x: np.ndarray, trees: tuple[np.ndarray, ...]) -> np.ndarray:
    """Log odds that a node holds main text."""
    feature, cut, left, right, value, roots = trees
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for root in roots:
        at = np.full(len(x), root)
        while True:
            down = np.where(x[rows, feature[at]] <= cut[at], left[at], right[at])
            if (down == at).all():
                break
            at = down
        total += value[at]
    return 2 * total


def decode(forest: dom.Forest, odds: np.ndarray) -> np.ndarray:
    """The nodes to open: the greatest sum of log odds of open nodes among all choices without contradiction."""
    n = len(forest.parent)
    gain = odds.tolist()  # of opening a node: its own odds and what its children then gain
    below, least = [0.0] * n, [-math.inf] * n  # sum of children's gains above 0; the best child's gain
    for k in range(n - 1, -1, -1):
        if forest.text[k] is None:
            if least[k] == -math.inf:
                gain[k] = -math.inf  # nothing below that could open
            else:
                gain[k] += below[k] + min(least[k], 0.0)
        parent = forest.parent[k]
        if parent >= 0:
            below[parent] += max(gain[k], 0.0)
            least[parent] = max(least[parent], gain[k])
    open_ = [False] * n
    served = [False] * n  # has an open child
    for k in range(n):
        parent = forest.parent[k]
        if parent < 0:
            open_[k] = gain[k] > 0
        elif open_[parent]:
            # The best child opens in any case; of equally good ones the first.
            open_[k] = gain[k] > 0 or gain[k] == least[parent] and least[parent] <= 0 and not served[parent]
            served[parent] |= open_[k]
    return np.array(open_, bool)


def texts(html: list[str], model: Model) -> list[str]:
    """Main texts of whole pages: text blocks in page order between empty lines."""
    known, trees = model
    forest = dom.Forest()
    for page in html:
        forest.add(page)
    chosen = decode(forest, margins(dom.features(forest, known), trees))
    out = []
    for root in forest.roots:
        out.append("\n\n".join(forest.text[k] for k in range(root, forest.end[root]) if chosen[k] and forest.text[k] is not None))
    return out


def extract(df: DataFrame, html: str = "html", text: str = "main_text", model: Model | None = None, keep: list[str] | None = None) -> DataFrame:
    """Append ``text``, the main text of the page, to every row.

    Null and empty pages, and pages without main text, give an empty text. Equal pages give equal texts. A column
    named like ``text`` is replaced; ``keep`` names the columns of ``df`` to return (all by default).
    """
    model = model or fit(df.sparkSession)
    kept = [c for c in (df.columns if keep is None else keep) if c != text]
    rows = df.select(F.struct(*([F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("none")])).alias("_row"), F.col(f"`{html}`").cast("string").alias("_html"))
    schema = T.StructType([rows.schema["_row"], T.StructField("_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks.slices(batches, "_html", SLICE_BYTES):
            made = texts([h or "" for h in part.column("_html").to_pylist()], model)
            yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(made, pa.string())], names=["_row", "_text"])

    made = rows.mapInArrow(run, schema)
    return made.select(*(F.col(f"_row.`{c}`").alias(c) for c in kept), F.col("_text").alias(text))
