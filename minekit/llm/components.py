"""Connected components of a link table, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from minekit.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """``links`` has long columns a and b. One row per linked node: node, root (the least node it reaches).

    Every round each node takes the least neighbour as its parent, parents are followed twice more, and the
    links are drawn anew between parents. Chains get shorter by a factor of eight a round, stars end at once.
    """
    left = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p")))
        for _ in range(2):
            above = parent.select(F.col("node").alias("p"), F.col("p").alias("q"))
            parent = cut(parent.join(above, "p").select("node", F.col("q").alias("p")))
        if labels is None:
            labels = parent.withColumnRenamed("p", "root")
        else:
            step = parent.select(F.col("node").alias("root"), "p")
            labels = cut(labels.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        to_a, to_b = parent.select(F.col("node").alias("a"), F.col("p").alias("pa")), parent.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        left = cut(
            left.join(to_a, "a").join(to_b, "b").filter("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
