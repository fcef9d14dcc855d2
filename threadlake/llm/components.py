"""Connected components of a graph held as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b: bigint, no self loops needed); the label
    is the smallest node that can be reached.

    Each round takes the smallest label among a node and its neighbours, then the label of that
    label, so that long chains shrink by doubling. A round is written out, with whether a label
    changed; nothing but that one flag reaches the driver. Labels only fall, so it ends.
    """
    both = scratch.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label"))
    labels = scratch.write(labels, "labels0")
    at = 0
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        step = scratch.write(step, f"step{at}")
        jump = step.select(F.col("node").alias("via"), F.col("label").alias("further"))
        after = step.join(jump, step["label"] == jump["via"]).select("node", F.col("further").alias("label"), (F.col("further") < F.col("before")).alias("moved"))
        after = scratch.write(after, f"labels{at + 1}")
        scratch.drop(f"step{at}", f"labels{at}")
        labels, at = after.select("node", "label"), at + 1
        if not after.where("moved").limit(1).count():
            return labels
