"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014) over an edge table.

Every step writes its edges to the shared folder, so lineage stays short and lost executors cost one step. Nothing is
collected but one count and checksum a step. Minimums are pre-aggregated before each shuffle, and the joins that
follow stand directly under the write, so Spark can split a hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerview.llm.common import cut, drop_cut

MOST_ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    up = both.filter("v > u")
    return up.join(least, up.u == least.k).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    moved = edges.join(least, edges.u == least.k).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))


def _round(now: DataFrame) -> DataFrame:
    """One large-star and one small-star step: fewer, shorter edges with the same components."""
    wide = cut(_large(now), "large-star")
    then = cut(_small(wide.distinct()).distinct(), "small-star")
    drop_cut(wide)
    drop_cut(now)
    return then


def contracted(edges: DataFrame, rounds: int) -> DataFrame:
    """Edges (u > v) with the same components after some rounds, not yet stars."""
    now = cut(edges.select("u", "v").distinct(), "edges")
    for _ in range(rounds):
        now = _round(now)
    return now


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for every node u of `edges` (u > v in every row) that is not its component's least node v."""
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = cut(edges.select("u", "v").distinct(), "edges")
    seen = state(now)
    for _ in range(MOST_ROUNDS):
        if not seen[0]:
            return now
        now = _round(now)
        found = state(now)
        if found == seen:
            return now
        seen = found
    raise RuntimeError("components did not settle")
