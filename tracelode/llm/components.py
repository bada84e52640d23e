"""Connected components of an edge table, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id in edges a, b (long, not null); loops are allowed.

    Each round a node takes the smallest label among its neighbours', then the label of that label, so paths shorten
    by halves. Rounds end when no label changes. Labels and edges are tables in the shared folder; a node with very many
    neighbours is pre-aggregated by each task.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))  # one pass over what makes the edges
    both = stored(edges.select(ways.alias("w")).select("w.a", "w.b"), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        of = labels.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
        jumped = lower.join(of, F.col("component") == F.col("_id"), "left")
        after = stored(jumped.select("id", "before", F.least("component", "_component").alias("component")), "labels")
        changed = not after.where("component <> before").isEmpty()
        drop_stored(labels)
        labels = after.select("id", "component")
        if not changed:
            drop_stored(both)
            return labels
