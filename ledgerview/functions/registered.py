"""Server-side functions: callables on the engine, called by name from an allow-list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_known: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _known[name.lower()] = f
        return f

    return add


def call(name: str, engine, where: str = "", *args) -> DataFrame:
    if name.lower() not in _known:
        raise KeyError(f"no function named {name}")
    return _known[name.lower()](engine, where, *args)


@register("sum_by_product")
def sum_by_product(engine, where: str, view: str = "SalesItemRows") -> DataFrame:
    """TotalPrice and TotalQTY of each product among the rows that match."""
    rows = engine.query(view, where).df
    return rows.groupBy("Product").agg(F.sum("Price").alias("TotalPrice"), F.sum("QTY").alias("TotalQTY"))
