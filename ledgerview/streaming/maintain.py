"""Incremental maintenance with Structured Streaming: views, full-text postings and counters follow the log.

Each query keeps its place in a checkpoint. Micro-batches are written under their batch number, so a batch that is run
again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerview.functions.fulltext import postings
from ledgerview.sources import store


def _run(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None):
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
    if interval is None:
        query.awaitTermination()
    return query


def _log_stream(spark: SparkSession, path: str, files: int | None) -> DataFrame:
    reader = spark.readStream.schema(store.LOG)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def follow_view(spark: SparkSession, log_path: str, mapper: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, interval: str | None = None, files: int | None = None):
    """Append mapped rows, and a mark (docid, version, is_deleted) for every entry, mapped or not; `current_view` reads the state."""

    def step(batch: DataFrame, number: int) -> None:
        rows = mapper(batch.filter(~F.col("is_deleted"))).withColumn("is_mark", F.lit(False))
        marks = batch.select("docid", "version", "is_deleted", F.lit(True).alias("is_mark"))
        rows.unionByName(marks, allowMissingColumns=True).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _run(_log_stream(spark, log_path, files), step, checkpoint, interval)


def current_view(spark: SparkSession, out: str) -> DataFrame:
    """Rows of the latest version of every docid that is not deleted; equal to a rebuild from the log."""
    rows = spark.read.parquet(out).drop("batch")
    # a version that maps to nothing still hides the rows of those before it
    # maximums of numbers are hashed, those of structs would sort all marks; of equal versions a tombstone counts
    of = lambda state: F.max(F.when(state, F.col("version")))
    last = rows.filter("is_mark").groupBy("docid").agg(F.max("version").alias("version"), of(~F.col("is_deleted")).alias("live"), of(F.col("is_deleted")).alias("dead"))
    last = last.filter("live = version and (dead is null or dead < version)")
    return rows.filter(~F.col("is_mark")).drop("is_deleted", "is_mark").join(last.select("docid", "version"), ["docid", "version"], "left_semi")


def follow_text(spark: SparkSession, log_path: str, out: str, checkpoint: str, interval: str | None = None, files: int | None = None):
    """Append (version, word) postings of new documents."""

    def step(batch: DataFrame, number: int) -> None:
        postings(batch.filter(~F.col("is_deleted")), "version", "body").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _run(_log_stream(spark, log_path, files), step, checkpoint, interval)


def follow_counters(deltas: DataFrame, name: str, checkpoint: str):
    """Running totals of a stream of (key, delta) as an in-memory table."""
    totals = deltas.groupBy("key").agg(F.sum("delta").alias("value"))
    return totals.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
