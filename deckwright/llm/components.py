"""Connected components of links between documents, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the least node that it can reach.

    Each round every node takes the least label around it, and then the label of that label; rounds grow with
    the logarithm of the longest chain.  Labels around a node are aggregated before they are shuffled.  The two
    joins do meet on a node with very many links, and on a label that very many nodes have: these rows are two or
    three numbers each, the other side has one row a node, and beyond the size at which adaptive execution calls a
    partition skewed it splits it.  Nothing of the graph comes to the driver but whether anything changed.
    """
    both = links.where(F.col("a") != F.col("b")).select("a", "b").unionByName(links.where(F.col("a") != F.col("b")).select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = common.cut(both)
    labels = common.cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("around"))
        near = labels.join(seen, "node").select("node", "component", F.least("component", "around").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        moved = common.cut(near.join(jump, "next", "left").select("node", F.least("next", F.coalesce("beyond", "next")).alias("next"), "component"))
        changed = moved.where(F.col("next") != F.col("component")).limit(1).count()
        labels = moved.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
