"""Connected components of a graph of links, by tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (the smallest node reachable) for each node of links(a long, b long).

    Each round takes the least label among a node and its neighbours and then
    the label of that label (pointer jumping), so long chains halve. Each round
    is a written table; nothing but a count goes to the driver.
    """
    edges = scratch.keep(f"{name}-edges", links.where("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*").distinct())
    labels = scratch.keep(f"{name}-0", edges.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component"), F.lit(True).alias("changed")))
    i = 0
    while True:
        i += 1
        near = edges.join(labels.select(F.col("node").alias("src"), "component"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        step = scratch.keep(f"{name}-{i}a", step)
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = step.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("up", "component")).alias("component"))
        new = scratch.keep(f"{name}-{i}", new.select("node", "component", (F.col("old") != F.col("component")).alias("changed")))
        scratch.drop(f"{name}-{i}a", f"{name}-{i - 1}")
        labels = new
        if labels.where("changed").isEmpty():
            scratch.drop(f"{name}-edges")
            return labels.select("node", "component")
