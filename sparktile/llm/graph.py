"""Connected components of a link table by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): component is the smallest node that can be reached.

    Each round gives every node the smallest label among itself and its neighbours, then follows labels of labels, so chains
    shorten geometrically.  Rounds are written under ``spark.checkpoint.dir``: lost executors cost one round at most.  Sums are
    combined before shuffles and a node with very many links is only a skewed join key.
    """
    spark = links.sparkSession
    edges_path = scratch_path(spark, "links")
    links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().write.parquet(edges_path)
    edges = spark.read.parquet(edges_path)
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"))
    step = 0
    while True:
        path = scratch_path(spark, f"labels-{step}")
        labels.write.parquet(path)
        old = spark.read.parquet(path)
        if step and old.where("changed").isEmpty():
            return old.select("node", "component")
        old = old.select("node", "component")
        near = (
            edges.join(old.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        )
        moved = old.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "m").alias("c"))
        jump = old.select(F.col("node").alias("c"), F.col("component").alias("j"))
        least = F.least("c", F.coalesce("j", F.col("c")))
        labels = moved.join(jump, "c", "left").select("node", least.alias("component"), (least < F.col("before")).alias("changed"))
        step += 1
