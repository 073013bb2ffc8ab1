"""Backup, restore and replication as change feeds of the log."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerview.sources import store

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def type_glob(pattern: str, column: str = "typename") -> Column:
    """Whether a type name matches a glob with * and ?."""
    regex = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern)
    return F.col(column).rlike(f"^(?i:{regex})$")


def type_glob_matches(pattern: str, name: str) -> bool:
    return fnmatch.fnmatchcase(name.lower(), pattern.lower())


def changes_since(log: DataFrame, version: int, globs: tuple[str, ...] = (), deletes: bool = True, own_only: bool = False) -> DataFrame:
    """Entries after a version, of types that match a glob; own_only leaves out what came by replication."""
    found = log.filter(F.col("version") > version)
    if globs:
        wanted = type_glob(globs[0])
        for g in globs[1:]:
            wanted = wanted | type_glob(g)
        found = found.filter(wanted | F.col("is_deleted") if deletes else wanted)
    if not deletes:
        found = found.filter(~F.col("is_deleted"))
    return found.filter(~F.col("is_replicated")) if own_only else found


def apply_changes(log: DataFrame, changes: DataFrame) -> DataFrame:
    """The log with a package from elsewhere, marked so that it is not sent back.

    Versions number each node's own log, so entries are known by docid, time, state and content, and get new versions
    after all that are here, in their order; a package that comes twice adds nothing.
    """
    mark = lambda df: df.withColumn("__same", F.xxhash64("docid", "typename", "ts", "is_deleted", "body"))
    last = log.agg(F.coalesce(F.max("version"), F.lit(0)).alias("__last"))
    new = mark(changes.withColumn("is_replicated", F.lit(True))).join(mark(log).select("__same"), "__same", "left_anti")
    new = new.crossJoin(F.broadcast(last)).withColumn("version", F.col("version") + F.col("__last"))  # one row
    return log.unionByName(new.select(*log.columns))


def packages(changes: DataFrame, rows: int = 10_000) -> DataFrame:
    """changes with a column `package`: ranges of `rows` versions, so that each can be sent and applied by itself."""
    return changes.withColumn("package", F.floor(F.col("version") / rows).cast("long"))


def backup(log: DataFrame, since: int, path: str) -> None:
    """Entries after `since` as gzipped JSON lines."""
    log.filter(F.col("version") > since).write.mode("append").option("timestampNTZFormat", STAMP).json(path, compression="gzip")


def restore(spark, path: str, out: str, checkpoint: str) -> None:
    """Read backup files once each into the log at `out`; the checkpoint lets a broken run go on."""
    stream = spark.readStream.schema(store.LOG).option("timestampNTZFormat", STAMP).json(path)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
