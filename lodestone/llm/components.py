"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, label): the smallest node that each node of an edge reaches.

    A round hooks every node to the least label around it and then follows that
    label's own label, so the rounds grow with the logarithm of a component's
    width. Every round's labels are written to the shared folder. Minima combine
    before the shuffle, so a node with very many edges costs no task more.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = cut(both.union(both.select("v", "u")).distinct(), "edges")
    labels = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumnRenamed("u", "node"), "labels")
    for _ in range(most):
        around = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(hooked.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        moved = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {most} rounds")
