"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import pinned


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): ``component`` is the smallest node reachable from ``node``.

    Each round takes the smallest label among a node's neighbours (a partial and a
    final ``min``, so a hub is combined before the shuffle), then follows the label's
    own label, which doubles the distance covered. Labels live in a checkpointed table;
    only the number of changed labels comes to the driver. Rows with a null end and
    self-loops are dropped; repeated edges are harmless; an empty table gives no rows.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = pinned(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = pinned(both.groupBy(F.col("u").alias("node"))
                    .agg(F.min("v").alias("m"))
                    .select("node", F.least("node", "m").alias("label")))
    while True:
        near = (both.join(labels.withColumnRenamed("node", "v"), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near")))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        stepped = pinned(hooked.join(up, "label").select("node", "was", F.least("label", "up").alias("label")))
        changed = stepped.where("label <> was").limit(1).count()
        labels = stepped.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
