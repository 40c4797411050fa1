"""Connected components by minimum labels and pointer jumps, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) for every vertex of the undirected ``edges`` (a, b); comp is the smallest vertex reachable."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("v"), F.least("a", "low").alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("comp").alias("low"))
        step = labels.join(near, labels["v"] == near["a"]).select("v", F.least("comp", "low").alias("comp"), F.col("comp").alias("was"))
        step = stored(step, "labels")
        up = step.select(F.col("v").alias("u"), F.col("comp").alias("top"))
        new = stored(step.join(up, step["comp"] == up["u"]).select("v", F.least("comp", "top").alias("comp"), "was"), "labels")
        labels = new.select("v", "comp")
        if new.where("comp <> was").isEmpty():
            return labels
