"""Connected components of a table of links, by smallest labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helixbag.session import materialize


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node that links lead to.

    Each round gives a node the smallest label among itself, its neighbours and what its label points to, so chains halve;
    a round's labels are written to the shared checkpoint folder, and only the number of changes reaches the driver.
    Grouped minima are pre-aggregated, so a node with most links is no hot group. Links may repeat, loop or be absent.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    edges = materialize(both, f"{label}-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), label)
    while True:
        seen = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("component").alias("_least"))
        near = labels.join(seen, labels.node == seen.a, "left").select(
            "node", "component", F.least("component", F.coalesce("_least", "component")).alias("_near"))
        roots = near.select(F.col("node").alias("_root"), F.col("_near").alias("_far"))
        # A root that found a smaller label hands it to all that point to it.
        jumped = near.join(roots, F.col("_near") == F.col("_root"), "left").select(
            "node", F.col("component").alias("_old"), F.least("_near", F.coalesce("_far", "_near")).alias("component"))
        stored = materialize(jumped, label)
        labels = stored.select("node", "component")
        if stored.where("component <> _old").isEmpty():
            return labels
