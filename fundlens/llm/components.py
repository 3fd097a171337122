"""Connected components of an undirected graph, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b); the label is the least node reachable.

    Each round takes the least label among a node and its neighbours and then the label of
    that label, so labels travel twice as far each round.  A round is written to the shared
    folder before the next.  Joins spread a node with many links by adaptive splitting, and
    minima are combined before they are shuffled.  Links with a null end have no effect.
    """
    usable = links.where("a is not null and b is not null")
    both = usable.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
        usable.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    both = materialize(both.distinct(), "links")
    labels = both.groupBy("node").agg(F.min("other").alias("least"))
    labels = materialize(labels.select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        known = labels.withColumnsRenamed({"node": "other", "label": "near"})
        near = both.join(known, "other").groupBy("node").agg(F.min("near").alias("near"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        least = materialize(least, "labels")
        jump = least.select(F.col("node").alias("next"), F.col("next").alias("far"))
        moved = least.join(jump, "next").select("node", F.col("label").alias("was"), F.least("next", "far").alias("label"))
        moved = materialize(moved, "labels")
        if moved.where("was <> label").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")
