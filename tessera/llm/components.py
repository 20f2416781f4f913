"""Connected components of a link table by repeated minimum labels with pointer jumping, every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """v, label for each end of links (a, b): label is the smallest v reachable. Rounds grow with the logarithm of a chain's length."""
    both = links.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("w")))
    edges = materialize(both.filter("v <> w").distinct())
    labels = materialize(edges.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("v").alias("w"), F.col("label").alias("n")), "w").groupBy("v").agg(F.min("n").alias("n"))
        lower = labels.join(near, "v").select("v", F.col("label").alias("was"), F.least("label", "n").alias("up"))
        jump = labels.select(F.col("v").alias("up"), F.col("label").alias("top"))
        new = materialize(lower.join(jump, "up", "left").select("v", "was", F.least("up", F.coalesce("top", "up")).alias("label")))
        changed = not new.filter("label <> was").isEmpty()
        labels = new.select("v", "label")
        if not changed:
            return labels
