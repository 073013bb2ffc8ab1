"""The append-only document log: versions, tombstones, history, point-in-time reads; and the file log.

A log is a DataFrame (docid, typename, version, ts, is_deleted, is_replicated, body). Everything is a pure function of
it. Latest versions come from max_by aggregates, which combine before the shuffle, not from windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = "docid string, typename string, version long, ts timestamp_ntz, is_deleted boolean, is_replicated boolean, body string"


def latest(log: DataFrame, key: str = "docid", dead: str = "is_deleted") -> DataFrame:
    """The last version of every key, without keys whose last entry is a tombstone."""
    rest = [c for c in log.columns if c != key]
    top = log.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("__top"))
    return top.filter(~F.coalesce(F.col(f"__top.{dead}"), F.lit(False))).select(key, "__top.*").select(*log.columns)


def fetch(log: DataFrame, docid) -> DataFrame:
    """The live document of one id: no row if there is none."""
    return latest(log.filter(F.col("docid") == docid))


def lives(log: DataFrame, key: str = "docid") -> DataFrame:
    """Entries after the last tombstone of their key."""
    dead = log.filter("is_deleted").groupBy(key).agg(F.max("version").alias("__dead"))
    return log.join(dead, key, "left").filter("__dead is null or version > __dead").drop("__dead")


def history(log: DataFrame, value=None, key: str = "docid") -> DataFrame:
    """Key and version of all entries that can still be reached, of one key or of all; files have key fileid."""
    some = log if value is None else log.filter(F.col(key) == value)
    return lives(some, key).select(key, "version")


def history_info(log: DataFrame, value=None, key: str = "docid") -> DataFrame:
    """history() with the time of each change."""
    some = log if value is None else log.filter(F.col(key) == value)
    return lives(some, key).select(key, "version", F.col("ts").alias("change_date"))


def fetch_version(log: DataFrame, version: int) -> DataFrame:
    """The entry with a record number, in any state of its document."""
    return log.filter(F.col("version") == version)


def document_count(log: DataFrame) -> DataFrame:
    """n: entries less two for each tombstone; n_live: ids that are alive."""
    per = log.groupBy("docid").agg(F.count("*").alias("c"), F.count_if("is_deleted").alias("t"), F.max_by("is_deleted", "version").alias("dead"))
    return per.agg((F.sum("c") - 2 * F.sum("t")).alias("n"), F.count_if(~F.col("dead")).alias("n_live"))


def append(log: DataFrame, docs: DataFrame, typename: str, start: int, deleted: bool = False, replicated: bool = False) -> DataFrame:
    """The log with docs(docid, ts, body, ordinal) added as versions start + ordinal."""
    new = docs.select(
        "docid", F.lit(typename).alias("typename"), (F.lit(start) + F.col("ordinal")).cast("long").alias("version"), "ts",
        F.lit(deleted).alias("is_deleted"), F.lit(replicated).alias("is_replicated"), "body",
    )
    return log.unionByName(new)


def delete(log: DataFrame, docids: DataFrame, start: int) -> DataFrame:
    """The log with tombstones for docids(docid, ts, ordinal)."""
    return append(log, docids.withColumn("body", F.lit(None).cast("string")), "", start, deleted=True)


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], LOG)


def write(log: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """A log as compressed Parquet in files of a bounded number of rows, by type."""
    log.write.mode("append").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").partitionBy("typename").parquet(path)


def read(spark, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def put_files(files: DataFrame, new: DataFrame, start: int) -> DataFrame:
    """The file log (fileid, version, ts, is_deleted, content) with new(fileid, ts, content, ordinal) added."""
    return files.unionByName(new.select("fileid", (F.lit(start) + F.col("ordinal")).cast("long").alias("version"), "ts", F.lit(False).alias("is_deleted"), "content"))


def fetch_file(files: DataFrame, fileid) -> DataFrame:
    return latest(files.filter(F.col("fileid") == fileid), "fileid")


def delete_file(files: DataFrame, gone: DataFrame, start: int) -> DataFrame:
    """The file log with tombstones for gone(fileid, ts, ordinal)."""
    new = gone.select("fileid", (F.lit(start) + F.col("ordinal")).cast("long").alias("version"), "ts", F.lit(True).alias("is_deleted"), F.lit(None).cast("binary").alias("content"))
    return files.unionByName(new)


def from_folder(spark, path: str, start: int = 0) -> DataFrame:
    """A folder of files as a file log; versions are the times of change in microseconds."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.col("path").alias("fileid"), (F.lit(start) + F.unix_micros("modificationTime")).alias("version"), F.col("modificationTime").cast("timestamp_ntz").alias("ts"), F.lit(False).alias("is_deleted"), "content")
