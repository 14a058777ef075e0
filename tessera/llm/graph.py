"""Connected components of an edge table, by alternating stars.

Each round points every node's larger neighbours at the smallest node of its
neighbourhood, then every node at the smallest of its smaller neighbours, until
nothing changes. Minima are pre-aggregated map-side and hubs meet their own
minimum in a join whose large partitions Spark can split; no neighbourhood, link
table or component is gathered in a task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v in; the same components with shorter ways out."""
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), F.least("u", "m").alias("m"))
    met = both.join(least, F.col("u") == F.col("hub"))
    if large:
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("hub").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """True if no node points at two nodes, and none that is pointed at points on."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for every node of an edge the smallest node it reaches."""
    now = saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while not _all_stars(now):
        now = saved(_star(_star(now, True), False), "edges")
    return labels(now, "u", "v")


def labels(stars: DataFrame, node: str, centre: str) -> DataFrame:
    """(node, component) from edges that point at the centre of their component."""
    own = stars.select(F.col(centre).alias("node"), F.col(centre).alias("component")).distinct()
    return stars.select(F.col(node).alias("node"), F.col(centre).alias("component")).union(own)
