"""Connected components of a link table, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.llm.common import staged


#: Links (both ways) up to which labels are broadcast: two keys each, some 25 MB at most.
FEW_LINKS = 400_000


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its
    least node.

    Every round a node takes the least label among its neighbours' and then the
    label of that label, so labels travel twice as far each round. Each round is a
    written table; minima are combined before the shuffle, and a hot node's rows
    are only ever the streamed side of a join. Labels of up to ``FEW_LINKS`` links
    (counted first) are broadcast instead of joined by key."""
    edges = staged(links.select("a", "b").union(links.select("b", "a")).where(F.col("a") != F.col("b")).distinct(),
                   "edges")
    small = F.broadcast if edges.count() <= FEW_LINKS else (lambda frame: frame)
    labels = staged(edges.groupBy(F.col("a").alias("node"))
                    .agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = (edges.join(small(labels.withColumnRenamed("node", "b")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        stepped = small(labels).join(near, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        ahead = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = staged(stepped.join(small(ahead), "component", "left").select(
            "node", "before", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where(F.col("component") != F.col("before")).isEmpty():
            return labels
