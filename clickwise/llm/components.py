"""Connected components of a link table, as rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickwise.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node of ``links`` (u, v).

    Each round a node takes the smallest root among its neighbours' (map-side
    combined), then the root of that root; rounds end when no root changes.  Their
    number is at most the longest path inside a component, mostly two or three."""
    edges = materialise(links.select("u", "v").union(links.select(F.col("v"), F.col("u"))).distinct())
    roots = materialise(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v"))
                             .select("node", F.least("node", "v").alias("root")))
    while True:
        around = (edges.join(roots.select(F.col("node").alias("v"), "root"), "v")
                       .groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near")))
        hooked = roots.join(around, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = materialise(hooked.join(up, "root").select("node", F.least("root", "top").alias("root"), "old"))
        done = new.filter("root != old").isEmpty()
        roots = new.select("node", "root")
        if done:
            return roots
