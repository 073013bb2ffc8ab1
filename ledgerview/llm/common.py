"""What the operators of this subpackage share: input columns, shared tables, worker set-up."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ledgerview.sources.shared import shared_dir

#: One word: a maximal run without ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Make this library importable in Python workers that start in another folder."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    return spark


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and return the table: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path  # type: ignore[attr-defined]
    return out


def remove(spark: SparkSession, path: str | None) -> None:
    """Delete a table in the shared folder, if there is one."""
    if path:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_cut(df: DataFrame) -> None:
    """Remove a table that cut() wrote and that nothing reads any more."""
    remove(df.sparkSession, getattr(df, "cut_path", None))
