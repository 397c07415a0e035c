"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tickloom.llm.shared import cut, drop


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _cut(e: DataFrame) -> tuple[DataFrame, tuple]:
    """A written table of links, and what tells it from another: counted while it is written."""
    seen = Observation()
    made = cut(e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
    return made, (seen.get["n"], seen.get["s"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for the nodes of ``links``; component is the least node of each.

    Each round is a written table, so no lineage grows; a node with many links only
    meets them in aggregates with map-side parts and in joins that may be split.
    """
    e, seen = _cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while seen[0]:
        before, larger = e, cut(_large(e))
        e, now = _cut(_small(larger))
        drop(before, larger)
        if now == seen:
            break
        seen = now
    least = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least.withColumn("component", F.col("node")))
