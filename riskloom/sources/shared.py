"""The shared folder of the cluster, and tables written there to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. Only a local session may fall back to a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get(SETTING, None) or sc.getConf().get(SETTING)
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="riskloom-")
        spark.conf.set(SETTING, named)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of this application, which may not have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(top)
    target = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, files in os.walk(top):
            for file in files:
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    out.write(path, os.path.join(name, os.path.relpath(path, top)))
    spark.sparkContext.addPyFile(target)  # Spark's own file server hands it out
    _shipped.add(app)


_written: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Compute once into a table of the shared folder and read that instead.

    Later stages then start from files that outlive a lost executor, read only the columns they
    need, and are planned with real sizes.
    """
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    _written.append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.table_path = path
    return table


TASK_ROWS = 10_000, 500_000  # for jobs that compute much on every row: fewer rows do not pay for a task, more are too many for one


def spread(df: DataFrame, rows: int) -> DataFrame:
    """Deal about so many ``rows`` out evenly over all cores, however few files hold them; a small table stays as it is."""
    least, most = TASK_ROWS
    parts = min(rows // least, max(df.sparkSession.sparkContext.defaultParallelism, rows // most))
    return df.repartition(parts) if parts > 1 else df


def written() -> list[str]:
    """Paths of the tables of this session that are not released yet."""
    return list(_written)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete tables this session materialized, all by default. Frames built on them stop working."""
    for name in list(_written) if paths is None else paths:
        if name in _written:
            _written.remove(name)
            delete(spark, name)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes the shuffle files of a written result as soon as it is written, not when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete on leaving what was materialized inside, but for the frames put into the list."""
    before, keep = set(_written), []
    try:
        yield keep
    finally:
        stay = before | {frame.table_path for frame in keep}
        release(spark, [p for p in _written if p not in stay])
