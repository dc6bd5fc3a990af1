"""Connected components of a table of links, with tables in the shared folder between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.scratch import materialise, release


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each end of ``links`` (a, b).

    A round takes the least label among a node and its neighbours, then the label's own label; so
    distances halve. It ends with the first round that changes nothing. Sums and joins only: a node
    with any number of links is never gathered in one place.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialise(both, "links")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        stepped = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        above = labels.select(F.col("node").alias("up"), F.col("component").alias("top"))
        new = stepped.join(above, stepped.component == above.up, "left").select("node", "old", F.least("component", F.coalesce("top", "component")).alias("component"))
        new = materialise(new, "labels")
        changed = new.where("component <> old").limit(1).count()
        release(labels)
        labels = new.drop("old")
        labels._seqloom_path = new._seqloom_path
        if not changed:
            release(both)
            return labels
