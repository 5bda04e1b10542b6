"""Connected components by label spreading with pointer jumps, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, hot_keys, join_hot, table


def components(links: DataFrame) -> DataFrame:
    """node, label for the nodes of links (a, b longs): label is the component's least node.

    Each round takes the least label among a node and its neighbours, then that label's own label;
    rounds follow the logarithm of a component's diameter on the stars and chains met here.  Every
    round is written to the shared folder, so no lineage grows.  The links of a hub and the nodes of one
    label are not gathered in a task.  No link, no rows."""
    spark = links.sparkSession
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = table(both, "links")
    hubs = hot_keys(both.groupBy("b").agg(F.count("*").alias("n")), ["b"], both.count())
    now = table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    nodes = now.count()
    while True:
        seen = join_hot(both, now.select(F.col("node").alias("b"), "label"), ["b"], hubs).groupBy("a").agg(F.min("label").alias("near"))
        near = now.join(seen, now.node == seen.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        near = table(near, "near")
        often = hot_keys(near.groupBy("mid").agg(F.count("*").alias("n")), ["mid"], nodes)
        jump = now.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = table(join_hot(near, jump, ["mid"], often).select("node", "old", F.least("mid", "far").alias("label")), "labels")
        changed = new.where("label != old").limit(1).count()
        drop(spark, now, near)
        now = new.select("node", "label")
        if not changed:
            drop(spark, both)
            return now
