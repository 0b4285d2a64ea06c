"""Connected components of a table of links, by repeated minimum and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import discard, materialise


def connected_components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for nodes of links (a, b). Every round is written to the shared folder."""
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = materialise(step.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        discard(labels)
        labels = new.select("node", "label")
        if new.filter("old <> label").isEmpty():
            discard(both)
            return labels
