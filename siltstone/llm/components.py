"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import crowd, forget, materialise, meet


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long), in one direction. node, label: the smallest node that each node reaches; nodes without an
    edge are absent. A round takes the smallest label of the neighbours, then the label of that label, so a path of n
    edges needs about log n rounds; labels are written to the shared folder after each, and those of the round before go. A label or node
    that many rows name (a giant component, a star) meets them by broadcast, see meet()."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "component-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "component-labels")
    n_edges, n_nodes = both.count(), labels.count()
    hubs = both.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd(n_edges)) if n_edges > crowd(n_edges) else None
    hubs = [r["b"] for r in hubs.collect()] if hubs is not None else []  # at most HEAVY
    while True:
        near = meet(both, labels.select(F.col("node").alias("b"), "label"), "b", n_edges, hubs).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("low"))
        held = materialise(low, "component-lows") if n_nodes > crowd(n_nodes) else None  # read twice where labels may be heavy
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        after = materialise(meet(low if held is None else held, jump, "low", n_nodes).select("node", F.least("low", "jump").alias("label"), (F.least("low", "jump") != F.col("was")).alias("moved")), "component-labels")
        moved = not after.where("moved").isEmpty()
        for gone in (held, labels):
            if gone is not None:
                forget(both.sparkSession, gone)
        labels = after.select("node", "label")
        if not moved:
            forget(both.sparkSession, both)
            return labels
