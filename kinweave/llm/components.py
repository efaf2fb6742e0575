"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.lineage import cut


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for the ends of ``links(a, b)``; the component is its smallest node.

    Each round a node takes the smallest label among its neighbours' and its own, then the label of
    that label, so labels travel twice as far each round. A round is written to the shared folder;
    it ends when no label changes. Minima are taken in part before the shuffle, so a hub is no hot key.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    while True:
        heard = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("least")))
        near = (labels.join(heard, labels["node"] == heard["a"])
                .select("node", F.col("component").alias("old"), F.least("component", "least").alias("label")))
        roots = labels.select(F.col("node").alias("root"), F.col("component").alias("above"))
        moved = cut(near.join(roots, near["label"] == roots["root"], "left")
                    .select("node", "old", F.least("label", F.coalesce("above", "label")).alias("component")))
        labels = moved.select("node", "component")
        if moved.filter("component <> old").isEmpty():
            return labels
