"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.frames import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of the undirected edges: comp is the component's smallest node.

    Each round a node takes the smallest label among its own and its
    neighbours', then the label of that label (pointer jumping), until no
    label changes; labels of a path meet in a logarithmic number of rounds.
    Labels are written to the shared folder between rounds; only the number
    of changed labels reaches the driver.
    """
    both = cut_lineage(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
                       .union(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
                       .filter(F.col("u") != F.col("v")).distinct(), "graph-edges")
    labels = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m"))
                         .select(F.col("u").alias("node"), F.least("u", "m").alias("comp")), "graph-labels")
    while True:
        near = (both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("comp").alias("m")))
        step = labels.join(near, labels["node"] == near["u"]).select(
            "node", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        # jump: the label of my label, as of the last round (labels only fall)
        up = labels.select(F.col("node").alias("n2"), F.col("comp").alias("c2"))
        step = cut_lineage(step.join(up, step["comp"] == up["n2"], "left").select(
            "node", "was", F.least("comp", F.coalesce("c2", "comp")).alias("comp")), "graph-labels")
        labels = step.select("node", "comp")
        if not step.filter(F.col("was") != F.col("comp")).limit(1).count():
            return labels
