"""Three classifier families behind one fit/predict: boosted trees of our own, Spark's random forest and logistic regression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.weights import combined_weight
from riskloom.plans import boosting
from riskloom.schema import CATEGORICAL, FEATURES, LABEL, NUMERIC, check_roles
from riskloom.sources.shared import materialize, scope

FAMILIES = ("gbt", "forest", "linear")
MISSING = "__missing__"
NUMBERS = [f"_x_{c}" for c in NUMERIC]
GAPS = [f"_na_{c}" for c in NUMERIC]
TEXTS = [f"_t_{c}" for c in CATEGORICAL]
CODES = [f"_c_{c}" for c in CATEGORICAL]

DEFAULTS = {
    "gbt": {"rounds": 100, "depth": 5, "rate": 0.15, "patience": 10, "row_share": 0.9, "leaf_rows": 5},
    "forest": {"numTrees": 60, "maxDepth": 8, "subsamplingRate": 0.8, "minInstancesPerNode": 5},
    "linear": {"maxIter": 60, "regParam": 0.01, "elasticNetParam": 0.0},
}


@dataclass
class Fitted:
    name: str
    model: PipelineModel | boosting.Boosted
    levels: dict[str, list[str]]
    info: dict = field(default_factory=dict)
    leaves: list | None = None  # of trees, once they have been read for attribution


def _one_hot_columns(levels: dict[str, list[str]]) -> dict[str, Column]:
    """One 0/1 column per trained level, per missing marker and for anything unseen."""
    made = {}
    for c, t in zip(CATEGORICAL, TEXTS):
        known = [*levels.get(c, []), MISSING]
        for i, level in enumerate(known):
            made[f"_h_{c}_{i}"] = (F.col(t) == F.lit(level)).cast("double")
        made[f"_h_{c}_{len(known)}"] = (~F.col(t).isin(known)).cast("double")
    return made


def model_inputs(df: DataFrame, name: str, levels: dict[str, list[str]]) -> DataFrame:
    """Columns a Spark learner can take: missing numbers become 0 plus a flag, missing text a level."""
    made = {}
    for c, x, na in zip(NUMERIC, NUMBERS, GAPS):
        v = F.col(c).try_cast("double")
        known = v.isNotNull() & ~F.isnan(v)
        made[x] = F.when(known, v).otherwise(F.lit(0.0))
        made[na] = (~known).cast("double")
    for c, t in zip(CATEGORICAL, TEXTS):
        made[t] = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    out = df.withColumns(made)
    return out.withColumns(_one_hot_columns(levels)) if name == "linear" else out


def learner_inputs(df: DataFrame, name: str, levels: dict[str, list[str]], *more: str) -> DataFrame:
    """Only what a learner's first stages read, the label, and the columns named."""
    hot = list(_one_hot_columns(levels)) if name == "linear" else TEXTS
    return model_inputs(df, name, levels).select(*NUMBERS, *GAPS, *hot, LABEL, *more)


def feature_slots(levels: dict[str, list[str]], one_hot: bool) -> list[int]:
    """For each slot of the feature vector, the index of the feature it belongs to."""
    slots = list(range(len(NUMERIC))) * 2
    for i, c in enumerate(CATEGORICAL):
        # Trained levels, the missing marker, and one slot for anything unseen.
        slots += [len(NUMERIC) + i] * (len(levels.get(c, [])) + 2 if one_hot else 1)
    return slots


def stages_of(name: str, levels: dict[str, list[str]], params: dict) -> list:
    known = [[*levels.get(c, []), MISSING] for c in CATEGORICAL]
    index = StringIndexerModel.from_arrays_of_labels(known, inputCols=TEXTS, outputCols=CODES, handleInvalid="keep")
    common = {"featuresCol": "features", "labelCol": LABEL, "weightCol": "weight", **DEFAULTS[name], **params}
    bins = max(32, max(len(k) for k in known) + 2)
    if name == "linear":
        hot = list(_one_hot_columns(levels))
        return [VectorAssembler(inputCols=[*NUMBERS, *GAPS, *hot], outputCol="features"), LogisticRegression(**common)]
    if name == "forest":
        gather = VectorAssembler(inputCols=[*NUMBERS, *GAPS, *CODES], outputCol="features")
        return [index, gather, RandomForestClassifier(seed=42, maxBins=bins, **common)]
    raise ValueError(f"unknown family {name!r}; choose from {FAMILIES}")


def fit(name: str, train: DataFrame, val_fit: DataFrame, levels: dict[str, list[str]],
        params: dict | None = None, half_life: float | None = None) -> Fitted:
    """Fit one family with class-balanced, recency-weighted rows.

    ``val_fit`` only decides when boosting stops; it must be the earlier validation slice.
    """
    only(train, "train"), only(val_fit, "val_fit")
    check_roles(train)
    if name == "gbt":
        with scope(train.sparkSession):
            binning = boosting.learn_bins(train, levels)
            (model,) = boosting.fit_many(boosting.binned(train, val_fit, binning), binning,
                                         [boosting.Config(half_life=float(half_life or 0), **{**DEFAULTS[name], **(params or {})})])
        return Fitted(name, model, levels, model.info)
    stages = stages_of(name, levels, params or {})
    with scope(train.sparkSession):
        weighted = combined_weight(train, half_life)
        *ready, learner = stages
        inputs = materialize(learner_inputs(weighted, name, levels, "weight"))
        head = Pipeline(stages=ready).fit(inputs)
        rows = head.transform(inputs)
        model = PipelineModel([*head.stages, learner.fit(rows)])
        w = F.col("weight")
        stats = rows.agg(F.count(F.lit(1)), F.sum(LABEL), F.sum(w), F.sum(w * w), Summarizer.mean(F.col("features"))).first()
    info = {"rows_used": stats[0], "frauds_used": stats[1], "recency_half_life_days": half_life or 0,
            "effective_sample_size": round(stats[2] ** 2 / stats[3], 1) if stats[2] else 0.0}
    if name == "linear":
        info["means"] = stats[4].toArray().tolist()  # what a contribution is measured from
    return Fitted(name, model, levels, info)


def predict(fitted: Fitted, df: DataFrame, into: str | None = None) -> DataFrame:
    """Add the fraud probability as a column."""
    into = into or fitted.name
    if fitted.name == "gbt":
        return df.select(*df.columns, boosting.probabilities([fitted.model])(*boosting.raw_inputs())[0].alias(into))
    scored = fitted.model.transform(model_inputs(df, fitted.name, fitted.levels))
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(into))


def only(df: DataFrame, *allowed: str) -> DataFrame:
    """Refuse a frame that holds rows of any other split: the protocol as a check."""
    if "split" in df.columns:
        other = [r["split"] for r in df.select("split").where(~F.coalesce(F.col("split").isin(*allowed), F.lit(False))).limit(1).collect()]
        if other:
            raise ValueError(f"rows of split {other[0]!r} where only {allowed} may be used")
    return df


def save(fitted: Fitted, path: str) -> None:
    from riskloom.sources.sinks import write_document

    if fitted.name == "gbt":
        write_document(SparkSession.active(), f"{path}/{fitted.name}/trees", fitted.model.to_dict())
    else:
        fitted.model.write().overwrite().save(f"{path}/{fitted.name}/model")
    write_document(SparkSession.active(), f"{path}/{fitted.name}/about",
                   {"name": fitted.name, "levels": fitted.levels, "info": fitted.info})


def load(spark: SparkSession, path: str, names=FAMILIES) -> dict[str, Fitted]:
    """Load the named members; one that was never saved is left out."""
    from riskloom.sources.sinks import read_document

    out = {}
    for name in names:
        about = read_document(spark, f"{path}/{name}/about")
        if about:
            model = (boosting.Boosted.from_dict(read_document(spark, f"{path}/{name}/trees")) if name == "gbt"
                     else PipelineModel.load(f"{path}/{name}/model"))
            out[name] = Fitted(name, model, about["levels"], about["info"])
    return out
