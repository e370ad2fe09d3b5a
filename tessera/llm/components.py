"""Connected components of a table of links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node reachable.

    Each round a node takes the smallest label of its neighbours, then the label of its label; labels stop
    changing after a number of rounds that grows with the logarithm of the longest path.
    """
    edges = stage(
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u <> v")
        .unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v")).where("u <> v"))
        .distinct(),
        "edges",
    )
    labels = stage(edges.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("component")), "labels")
    while True:
        near = (
            edges.join(labels.withColumnRenamed("node", "v"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        hooked = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        parents = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        labels_next = stage(
            hooked.join(parents, "component", "left").select("node", "old", F.least("component", F.coalesce("above", "component")).alias("component")),
            "labels",
        )
        changed = labels_next.where("old <> component").limit(1).count()
        labels = labels_next.select("node", "component")
        if not changed:
            return labels
