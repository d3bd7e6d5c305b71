"""Connected components of a large edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scratch import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of `edges` (a, b); comp is the smallest node reachable.

    Each round takes the smallest label among neighbours and then jumps along labels, so chains shrink by halves.
    State and edges stay in shared tables; only the number of changed labels reaches the driver. No edges give no
    rows; loops and repeated edges do no harm.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        closer = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "near").alias("near"))
        closer = materialize(closer)
        jump = closer.select(F.col("node").alias("near"), F.col("near").alias("far"))
        after = materialize(closer.join(jump, "near").select("node", F.least("near", "far").alias("next"), "comp"))
        changed = after.filter("next <> comp").limit(1).count()
        discard(labels, closer)
        labels = after.select("node", F.col("next").alias("comp"))
        if not changed:
            discard(both)
            return labels
