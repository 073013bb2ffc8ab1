"""CSV and JSON in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_csv(df: DataFrame, path: str) -> None:
    """Header, every field quoted, quotes inside fields doubled."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def from_csv(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def to_json(*columns: str, pretty: bool = False) -> Column:
    return F.to_json(F.struct(*columns), {"pretty": "true"} if pretty else {})


def from_json(column: str, schema) -> Column:
    return F.from_json(column, schema)


def dynamic(column: str) -> Column:
    """JSON of unknown shape as a VARIANT, null where it is not JSON."""
    return F.try_parse_json(column)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, compression="gzip")
