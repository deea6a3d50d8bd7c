"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrace.session import cut

#: Links up to which one task is enough: rounds over more partitions would only start tasks.
SMALL = 1 << 16


def components(links: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """(node, component): the least node reachable over ``links``; nodes without a link do not appear.

    Each round takes the least label among the neighbours, a combinable minimum, so a
    hub is reduced before the shuffle, then jumps to the label's own label, which
    halves chains. Both tables are checkpointed, rounds stop when nothing moves. Up to ``small``
    rows they have one partition, which needs no shuffle.
    """
    one = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = cut(one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if both.count() <= small:
        both = cut(both.coalesce(1))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        hooked = cut(
            labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        )
        target = hooked.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        moved = cut(
            hooked.join(target, "label").select("node", F.least("label", "jump").alias("component"), (F.least("label", "jump") < F.col("old")).alias("moved"))
        )
        labels = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return labels
