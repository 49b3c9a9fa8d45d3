"""The review log with a snapshot: the state of all cases without reading the whole log again.

The log lies in directories ``stream=<name>/batch=<number>`` (see ``sinks.write_batch``). Compaction folds the batches
beyond the last snapshot into it and notes, for every stream, up to which batch the snapshot goes. Afterwards only later
batches are read: the marks are partition filters. Open cases stand in one table, written anew by each compaction;
closed cases are added to another, which only those events read that come in for a case it holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators import review
from riskloom.schema import REVIEW_EVENT
from riskloom.sources.readers import read_or_empty
from riskloom.sources.shared import materialize, scope
from riskloom.sources.sinks import write_batch

PLACE = [T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())]
MARK = T.StructType([T.StructField("version", T.LongType()), *PLACE, *(T.StructField(c, T.LongType()) for c in ("resolved", "approved", "declined"))])


class ReviewLog:
    """Cases of the log at ``log``; snapshots lie below ``store``. One writer compacts at a time, readers never wait."""

    def __init__(self, spark: SparkSession, log: str, store: str):
        self.spark, self.log, self.store = spark, log, store

    def append(self, events: DataFrame, stream: str, batch: int) -> None:
        """Write one batch; writing it again replaces it. Batches of a stream come in order."""
        write_batch(events.select(*(c for c in REVIEW_EVENT.names if c in events.columns)), self.log, stream, batch)

    def _marks(self) -> tuple[int, list]:
        """The last whole snapshot's number (0 for none) and its marks, one for each stream."""
        rows = read_or_empty(self.spark, f"{self.store}/marks", MARK).groupBy("stream").agg(F.max_by(F.struct("version", "batch", "resolved", "approved", "declined"), "version").alias("m")).collect()
        return max((r["m"]["version"] for r in rows), default=0), rows

    def tail(self, marks: list | None = None) -> DataFrame:
        """Events that the last snapshot does not hold."""
        marks = self._marks()[1] if marks is None else marks
        rows = read_or_empty(self.spark, self.log, T.StructType([*REVIEW_EVENT.fields, *PLACE]), "json", mode="DROPMALFORMED")
        later = [(F.col("stream") == r["stream"]) & (F.col("batch") > r["m"]["batch"]) for r in marks]
        known = F.col("stream").isin([r["stream"] for r in marks]) if marks else F.lit(False)
        return rows.where(reduce(lambda a, b: a | b, later, ~known))

    def _cases(self, kind: str, version: int) -> DataFrame:
        table = read_or_empty(self.spark, f"{self.store}/{kind}", T.StructType([*REVIEW_EVENT.fields, T.StructField("version", T.LongType())]))
        return table.where(F.col("version") == version if kind == "open" else F.col("version") <= version).drop("version")

    def _touched(self, version: int, marks: list) -> DataFrame:
        """The state of all open cases and of the closed ones that later events name."""
        tail = self.tail(marks).drop("stream", "batch")
        closed = self._cases("closed", version).join(tail.select("request_id").distinct(), "request_id", "left_semi")
        return review.state(self._cases("open", version).unionByName(closed).unionByName(tail))

    def pending(self) -> DataFrame:
        """As ``review.pending`` over the whole log."""
        version, marks = self._marks()
        return review.pending(self._touched(version, marks))

    def state(self) -> DataFrame:
        """As ``review.state`` over the whole log."""
        version, marks = self._marks()
        return review.state(self._cases("open", version).unionByName(self._cases("closed", version)).unionByName(self.tail(marks).drop("stream", "batch")))

    def stats(self) -> DataFrame:
        """As ``review.stats`` over the whole log: counts of the snapshot plus those of later events."""
        version, marks = self._marks()
        seen = {c: sum(r["m"][c] for r in marks) for c in ("resolved", "approved", "declined")}
        later = review.counts(self.tail(marks))
        pending = review.pending(self._touched(version, marks)).agg(F.count(F.lit(1)).alias("pending")).scalar()
        return later.select(*[(F.col(c) + n).alias(c) for c, n in seen.items()]).withColumn("pending", pending)

    def compact(self) -> int:
        """Fold what is new into a snapshot and return its number. Marks are written last: without them it does not count."""
        version, marks = self._marks()
        with scope(self.spark):
            # What is folded and what is marked must be the same batches, also if more come in meanwhile.
            new = materialize(self.tail(marks))
            ends = new.groupBy("stream").agg(F.max("batch").alias("batch"), *review.count_columns()).collect()
            if not ends:
                return version
            rows = new.drop("stream", "batch")
            closed = self._cases("closed", version).join(rows.select("request_id").distinct(), "request_id", "left_semi")
            state = materialize(review.state(self._cases("open", version).unionByName(closed).unionByName(rows)))
            for kind, event in (("open", "queued"), ("closed", "resolved")):
                state.where(F.col("event") == event).select(*REVIEW_EVENT.names).write.mode("overwrite").parquet(f"{self.store}/{kind}/version={version + 1}")
            old = {r["stream"]: r["m"] for r in marks}
            add = {r["stream"]: r for r in ends}
            made = []
            for stream in old.keys() | add.keys():
                a, b = old.get(stream), add.get(stream)
                counts = [(a[c] if a else 0) + (b[c] if b else 0) for c in ("resolved", "approved", "declined")]
                made.append((version + 1, stream, b["batch"] if b else a["batch"], *counts))
            self.spark.createDataFrame(made, MARK).coalesce(1).drop("version").write.mode("overwrite").parquet(f"{self.store}/marks/version={version + 1}")
        return version + 1
