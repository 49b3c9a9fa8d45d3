"""Typed scans of the raw inputs, the split table and the logs."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.schema import CARD_COLUMNS, FEATURES, LABEL, REVIEW_EVENT, TRANSACTIONS, USER_COLUMNS


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``{"target": {"<id>": "Yes" | "No", ...}}`` as (id, is_fraud).

    The map is one JSON value however many ids it holds, so it is not parsed as one document:
    the comma is the record separator, which lets Spark split the file into any number of tasks.
    """
    entry = r'"(\d+)"\s*:\s*"(\w+)"'
    parts = spark.read.text(path, lineSep=",").where(F.col("value").rlike(entry))
    return parts.select(
        F.regexp_extract("value", entry, 1).cast("bigint").alias("id"),
        (F.regexp_extract("value", entry, 2) == "Yes").cast("int").alias(LABEL),
    )


def read_transactions(spark: SparkSession, path: str, labels: DataFrame | None = None) -> DataFrame:
    """The transaction file with a fixed schema; with labels given, only labelled rows and their label."""
    # The header line gives the column order of this file; columns not in the schema are skipped.
    known = {f.name: f for f in TRANSACTIONS.fields}
    header = spark.read.csv(path, header=True).columns
    layout = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
    rows = spark.read.csv(path, header=True, schema=layout).select(*TRANSACTIONS.fieldNames())
    return rows if labels is None else rows.join(labels, "id")


def _dimension(spark: SparkSession, path: str, key: str, columns: Sequence[str]) -> DataFrame:
    # Dimension files carry columns that are never used (some of them personal data): text in, few out.
    raw = spark.read.csv(path, header=True).withColumnRenamed("id", key)
    return raw.select(F.col(key).cast("int").alias(key), *[c for c in columns if c != key])


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    return _dimension(spark, path, "card_id", CARD_COLUMNS)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return _dimension(spark, path, "client_id", USER_COLUMNS)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """A small JSON object code -> name as (mcc, name). A code list is one short document."""
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.explode(F.from_json("value", "map<string,string>")).alias("code", "name")).select(
        F.col("code").cast("int").alias("mcc"), "name")


def read_split(spark: SparkSession, path: str, split: str | None = None,
               columns: Sequence[str] | None = None) -> DataFrame:
    """The split table; a split name prunes partitions, a column list prunes the scan."""
    table = spark.read.parquet(path)
    if split is not None:
        table = table.where(F.col("split") == split)
    return table.select(*columns) if columns else table


def read_xy(spark: SparkSession, path: str, split: str, levels: DataFrame | None = None) -> DataFrame:
    """Features and label of a split; with the trained ``levels``, a level that training did not see is missing."""
    from riskloom.operators.context import align_levels

    rows = read_split(spark, path, split, ["id", *FEATURES, LABEL])
    return rows if levels is None else align_levels(rows, levels)


def read_log(spark: SparkSession, path: str, schema: T.StructType | str = REVIEW_EVENT) -> DataFrame:
    """An append-only JSON Lines log; lines that are no JSON are skipped."""
    return read_or_empty(spark, path, schema, "json", mode="DROPMALFORMED")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet", **options) -> DataFrame:
    """A stored table, or an empty one of the same shape where it was never written."""
    try:
        return spark.read.schema(schema).options(**options).format(kind).load(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


#: What Spark says of a file that is no table or not one of this shape.
UNREADABLE = ("is not a Parquet file", "CANNOT_READ_FOOTER", "UNABLE_TO_INFER_SCHEMA", "PARQUET_COLUMN_DATA_TYPE_MISMATCH")


def read_artefact(spark: SparkSession, path: str, schema: T.StructType) -> list:
    """The rows of a small stored artefact; none where it is absent or cannot be read."""
    try:
        return read_or_empty(spark, path, schema).collect()
    except (PySparkException, Py4JJavaError) as exc:
        # A damaged file is as good as none; a lost cluster or a missing permission is not.
        if not any(sign in str(exc) for sign in UNREADABLE):
            raise
        return []
