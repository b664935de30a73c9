"""Connected components by joins: minimum labels over links, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import discard, stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b); label is the component's smallest node.

    Each round takes the smallest label among a node's own and its neighbours', then the label
    of that label. Rounds grow with the logarithm of a component's length. Labels are written to
    the shared folder after each round; only the count of changes comes to the driver.
    """
    links = links.select("a", "b").where("a <> b")
    both = stored(links.union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("m")), "b").groupBy(F.col("a").alias("node")).agg(F.min("m").alias("m"))
        # written, so that the next join has two plain shuffles: a component of very many nodes is one hot label
        low = stored(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "lower")
        jump = low.select(F.col("node").alias("label"), F.col("label").alias("of"))
        new = stored(low.join(jump, "label", "left").select("node", "old", F.least("label", "of").alias("label")), "labels")
        discard(labels, low)
        labels = new
        if new.where("old <> label").isEmpty():
            discard(both)
            return new.select("node", "label")
