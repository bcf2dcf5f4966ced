"""Connected components of pairs, by rounds of joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalcells.llm.scratch import Scratch


def components(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes of pairs (a, b) with the smallest node they reach: (node, component).

    Each round takes the smallest label among the neighbours and then the label of that label, so
    that long chains shrink by doubling. Only the count of changes reaches the driver.
    """
    both = scratch.write(pairs.select("a", "b").union(pairs.select("b", "a")).distinct()
                         .toDF("node", "other"), "neighbours")
    labels = scratch.write(
        both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        near = (both.join(labels.toDF("other", "label"), "other")
                .groupBy("node").agg(F.min("label").alias("label")))
        step = (labels.join(near, "node")
                .select("node", F.col("component").alias("before"),
                        F.least("component", "label").alias("next")))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        moved = scratch.write(
            step.join(jump, "next", "left")
            .select("node", "before",
                    F.least("next", F.coalesce("further", "next")).alias("component")), "labels")
        if moved.where("component != before").isEmpty():
            return moved.select("node", "component")
        scratch.drop(labels)
        labels = moved.select("node", "component")
        labels._scratch_path = moved._scratch_path
