"""The corpus pipeline: documents in, a cleaned and encoded training corpus out.

Every stage takes whole documents, with any further columns, and returns them with the same columns; the last one
adds token ids. ``run`` writes each stage's result to the shared folder and goes on from there; a stage's
result must be written before the next stage starts, as that deletes the stage's own tables.
"""

from __future__ import annotations

from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, jaccard, pieces, rules, suffix
from riskloom.llm.queries import PIECES
from riskloom.sources import shared


_left: list[str] = []


def stage(fn):
    """A stage: ships the package, and first deletes what the stage before it left, whose result has been written by then."""
    @wraps(fn)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.ship(spark)
        shared.release(spark, _left)
        before = set(shared.written())
        out = fn(spark, docs, sf_dir)
        _left[:] = [p for p in shared.written() if p not in before]
        return out

    return call


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.3 or more. It learns from the labels of these documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.classify(docs, labels, score="_score").where("_score >= 0.3").select(*(f"`{c}`" for c in docs.columns))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the least id; rows without an id stay, of repeated ids the least text."""
    groups = shared.materialize(jaccard.group(docs))
    stay = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_rows"))
    kept = docs.withColumnRenamed("_rows", "_rows_").join(stay, "doc_id") if "_rows" in docs.columns else docs.join(stay, "doc_id")
    columns = [F.col("_rows_" if c == "_rows" else f"`{c}`").alias(c) for c in docs.columns]
    parts = [kept.where("_rows = 1").select(columns), docs.where("doc_id IS NULL")]
    if not stay.where("_rows > 1").isEmpty():
        # The least text, then the least of the other columns as JSON, so that a task that is run again keeps the same row.
        twins = kept.where("_rows > 1").select(columns)
        whole = F.struct(*(f"`{c}`" for c in docs.columns))
        least = twins.groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(whole, F.struct("text", F.to_json(whole))).alias("_row"))
        parts.append(least.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns)))
    return reduce(DataFrame.unionByName, parts)


@stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; n_chars is counted anew.

    A cut inside a character drops what is left of it. Texts of which nothing is left stay, empty.
    """
    rest = [c for c in docs.columns if c != "text"]
    cut = suffix.remove(docs.select(F.col("doc_id").alias("_id"), "text", F.struct(*(f"`{c}`" for c in rest)).alias("_row")), key="_id", as_text="_text")
    columns = {c: F.col(f"_row.`{c}`") for c in rest} | {"text": F.col("_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*(columns[c].alias(c) for c in docs.columns))


@stage
def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rest = F.struct(*(f"`{c}`" for c in docs.columns if c != "text"))
    found = decontaminate.find(docs.select(F.col("text").alias("_text"), rest.alias("_row")), items, text="_text")
    columns = [F.col("_text" if c == "text" else f"_row.`{c}`").alias(c) for c in docs.columns]
    return found.where(F.size("hits") == 0).select(*columns)


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the text these decode to."""
    return pieces.encode(docs, PIECES, decoded="decoded")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("benchmark_free", benchmark_free), ("encoded", encoded)]

#: A classifier's verdict has no SQL; tests hold the other stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made: list[str] = []
    for _, fn in STAGES:
        docs = shared.materialize(fn(spark, docs, sf_dir))
        shared.release(spark, made)
        made = [docs.table_path]
    return docs
