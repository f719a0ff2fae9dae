"""Connected components of a link table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalox.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """Rows (id, component) for every id in ``links(a, b)``; the component is its smallest id.

    Each round takes the smallest label among an id's neighbours and then the label
    of that label, so the rounds grow with the logarithm of the longest chain.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        nearer = labels.join(around, "id").select("id", "component", F.least("component", "near").alias("next"))
        root = labels.select(F.col("id").alias("next"), F.col("component").alias("root"))
        after = materialize(nearer.join(root, "next", "left").select("id", F.least("next", F.coalesce("root", "next")).alias("component"), F.col("component").alias("before")), "labels")
        changed = after.filter("component <> before").limit(1).count()
        labels = after.select("id", "component")
        if not changed:
            return labels
