"""Streaming feedback: counters that accumulate over rounds.

State is a mergeable table on shared files: every batch adds a delta under its own number, and
once the deltas hold as many rows as the base they are merged into a new one.  So a batch writes
its own terms, all merges together write about twice the input, and a reader sees the base and
the deltas behind it.  A batch that runs again overwrites its delta.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from matchlake.operators.feedback import JOB_KEY, feedback_prefs, rerank_learned

#: Deltas of fewer rows are not worth a merge.
LEAST_ROWS = 10_000


def event_labels(events: DataFrame) -> DataFrame:
    """(profile_id, label, reward) of an event stream or table.

    A purchase counts as Accept, an error as Reject, everything else as Skip.
    """
    label = F.when(F.col("event_type") == "purchase", "Accept") \
        .when(F.col("event_type") == "error", "Reject").otherwise("Skip")
    return events.select(F.col("user_id").alias("profile_id"), label.alias("feedback_label"))


def label_counts(labels: DataFrame) -> DataFrame:
    """(profile_id, feedback_label, cnt)."""
    return labels.groupBy("profile_id", "feedback_label").agg(F.count(F.lit(1)).alias("cnt"))


# --- mergeable tables -------------------------------------------------------------------

def summed(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Merge of counters: rows of equal keys are added."""
    return lambda df: df.groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


def latest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Merge of labels: of equal keys the one of the largest ``seq`` stays."""
    return lambda df: df.groupBy(*keys).agg(
        F.max_by("feedback_label", "seq").alias("feedback_label"), F.max("seq").alias("seq"))


class MergeTable:
    """A base and the deltas behind it; ``merge`` brings rows of equal keys together."""

    def __init__(self, spark: SparkSession, path: str, schema: str,
                 merge: Callable[[DataFrame], DataFrame], least_rows: int = LEAST_ROWS):
        self.spark, self.path, self.schema, self.merge = spark, path, schema, merge
        self.least_rows = least_rows
        bases, deltas = self._complete("base"), self._complete("delta")
        self.upto = max(bases, default=-1)
        self.base_rows = self._read("base", [self.upto]).count() if bases else 0
        self.behind = {n: self._read("delta", [n]).count() for n in deltas if n > self.upto}

    def _complete(self, kind: str) -> list[int]:
        """Numbers of folders that were written to their end."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return []
        done = [f.getPath() for f in system.listStatus(folder) if f.isDirectory()]
        return sorted(int(p.getName()) for p in done if system.exists(
            self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _read(self, kind: str, numbers: list[int]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(
            *[f"{self.path}/{kind}/{n}" for n in numbers])

    def _write(self, df: DataFrame, kind: str, number: int) -> int:
        counted = Observation()
        df.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite") \
            .parquet(f"{self.path}/{kind}/{number}")
        return counted.get["rows"]

    def add(self, batch: DataFrame, number: int) -> None:
        """Rows of a batch; a batch that a base already holds is passed over."""
        if number <= self.upto:
            return
        self.behind[number] = self._write(self.merge(batch), "delta", number)
        if sum(self.behind.values()) >= max(self.least_rows, self.base_rows):
            self.base_rows = self._write(self.read(), "base", number)
            self.upto, self.behind = number, {}

    def read(self) -> DataFrame:
        """All rows so far, one per key."""
        parts = [self._read("base", [self.upto])] if self.upto >= 0 else []
        parts += [self._read("delta", sorted(self.behind))] if self.behind else []
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.merge(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))


def label_table(spark: SparkSession, path: str, **options) -> MergeTable:
    """Counts of labels per user."""
    return MergeTable(spark, path, "profile_id long, feedback_label string, cnt long",
                      summed(["profile_id", "feedback_label"]), **options)


def preference_table(spark: SparkSession, path: str, **options) -> MergeTable:
    """Counts per (profile, kind, term)."""
    return MergeTable(spark, path, "profile_id string, kind string, term string, cnt long",
                      summed(["profile_id", "kind", "term"]), **options)


def last_label_table(spark: SparkSession, path: str, **options) -> MergeTable:
    """Last label per (profile, posting)."""
    fields = "".join(f"{c} string, " for c in ("profile_id", *JOB_KEY))
    return MergeTable(spark, path, fields + "feedback_label string, seq long",
                      latest(["profile_id", *JOB_KEY]), **options)


# --- streams ----------------------------------------------------------------------------

def _start(stream: DataFrame, handle: Callable, checkpoint: str, trigger: dict | None
           ) -> StreamingQuery:
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint) \
        .trigger(**(trigger or {"availableNow": True})).start()


def stream_labels(events: DataFrame, counts: MergeTable, checkpoint: str,
                  trigger: dict | None = None) -> StreamingQuery:
    """Keep label counts of an event stream in ``counts``."""
    return _start(event_labels(events), lambda batch, number: counts.add(
        batch.withColumn("cnt", F.lit(1).cast("long")), number), checkpoint, trigger)


def stream_preferences(feedback: DataFrame, counts: MergeTable, checkpoint: str,
                       protected: Column | None = None, trigger: dict | None = None
                       ) -> StreamingQuery:
    """Keep the running (profile, kind, term) counters of a feedback stream in ``counts``."""
    return _start(feedback, lambda batch, number: counts.add(
        feedback_prefs(batch, protected), number), checkpoint, trigger)


def stream_rerank(feedback: DataFrame, baseline: DataFrame, counts: MergeTable, labels: MergeTable,
                  checkpoint: str, publish: Callable[[DataFrame, int], None],
                  protected: Column | None = None, k: int | None = None,
                  trigger: dict | None = None) -> StreamingQuery:
    """Re-rank the baseline after every batch from the counters and labels so far.

    Adjustments always start from the baseline scores, never from earlier results, and no
    earlier feedback is read again.  ``publish`` receives the new ranking and the batch number.
    """
    def handle(batch: DataFrame, number: int) -> None:
        counts.add(feedback_prefs(batch, protected), number)
        labels.add(batch.select("profile_id", *JOB_KEY, "feedback_label", "seq"), number)
        last = labels.read().select("profile_id", *JOB_KEY, F.col("feedback_label").alias("_label"))
        publish(rerank_learned(baseline, counts.read(), last, k), number)

    return _start(feedback, handle, checkpoint, trigger)
