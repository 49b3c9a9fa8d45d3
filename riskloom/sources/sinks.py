"""Where results go: the split table, predictions, reports and append-only logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from riskloom.schema import FEATURES, LABEL, VELOCITY, check_roles


def write_splits(df: DataFrame, path: str) -> None:
    """Features, velocity, label and keys, one directory per split."""
    extra = [c for c in VELOCITY if c in df.columns]
    check_roles(df).select("id", "date", "split", *FEATURES, *extra, LABEL).write.mode("overwrite").partitionBy("split").parquet(path)


def write_predictions(df: DataFrame, path: str, model: str) -> None:
    """Scores of one model, replacing only that model's directory."""
    df.write.mode("overwrite").parquet(f"{path}/model={model}")


def write_small(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A fitted artefact or report: a handful of rows in one file."""
    writer = df.coalesce(1).write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def write_document(spark: SparkSession, path: str, content: dict) -> None:
    """A settings document as one JSON line."""
    spark.createDataFrame([(json.dumps(content, default=float),)], "value string").coalesce(1).write.mode(
        "overwrite").text(path)


def read_document(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path).limit(1).collect()
        return json.loads(rows[0][0]) if rows else dict(default or {})
    except (AnalysisException, json.JSONDecodeError):
        return dict(default or {})


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_batch(df: DataFrame, path: str, stream: str, batch: int) -> None:
    """The rows of one micro-batch of one stream.

    A batch that the same stream replays overwrites itself, so nothing is logged twice. A stream with a new
    checkpoint has a new id and so leaves what others have written.
    """
    df.write.mode("overwrite").json(f"{path}/stream={stream}/batch={batch}")


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps with a stream's checkpoint for as long as that exists."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def quarantine(parsed: DataFrame, path: str) -> DataFrame:
    """Append the rejected requests of a batch to the log at ``path``; return the sound ones."""
    append_log(parsed.where("reject_reason IS NOT NULL").select("body", "reject_reason"), path)
    return parsed.where("reject_reason IS NULL").drop("body", "reject_reason")
