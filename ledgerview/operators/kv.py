"""The high-frequency key/value store as an event log (key, version, is_deleted, value): last value wins; counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_KEY_BYTES = 255


def current(log: DataFrame) -> DataFrame:
    """key and value of the keys that are there; combined before the shuffle."""
    top = log.groupBy("key").agg(F.max_by(F.struct("is_deleted", "value"), "version").alias("t"))
    return top.filter("not t.is_deleted").select("key", F.col("t.value").alias("value"))


def put(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with new(key, version, value); keys must be short."""
    checked = new.withColumn("key", F.when(F.octet_length("key") <= MOST_KEY_BYTES, F.col("key")).otherwise(F.raise_error(F.lit("key too long"))))
    return log.unionByName(checked.select("key", "version", F.lit(False).alias("is_deleted"), "value"))


def remove(log: DataFrame, gone: DataFrame) -> DataFrame:
    """The log with deletions of gone(key, version)."""
    return log.unionByName(gone.select("key", "version", F.lit(True).alias("is_deleted"), F.lit(None).cast(log.schema["value"].dataType).alias("value")))


def contains(log: DataFrame, key: str) -> bool:
    return not current(log.filter(F.col("key") == key)).isEmpty()


def keys(log: DataFrame, start: int = 0, count: int = -1) -> DataFrame:
    """Live keys in order, a page of them."""
    found = current(log).select("key").orderBy("key")
    found = found.offset(start) if start else found
    return found.limit(count) if count >= 0 else found


def count(log: DataFrame) -> DataFrame:
    return current(log).agg(F.count("*").alias("n"))


def counters(deltas: DataFrame) -> DataFrame:
    """Totals of increments and decrements (key, delta)."""
    return deltas.groupBy("key").agg(F.sum("delta").alias("value"))


def compact(log: DataFrame) -> DataFrame:
    """A log of the same state with one entry for each live key."""
    top = log.groupBy("key").agg(F.max("version").alias("version"), F.max_by(F.struct("is_deleted", "value"), "version").alias("t"))
    return top.filter("not t.is_deleted").select("key", "version", "t.is_deleted", "t.value")
