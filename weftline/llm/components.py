"""Connected components of a link table, by rounds of large-star and small-star on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import written


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    down = large.where(F.col("a") != F.col("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    small = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return small.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of *edges* (``a, b``) that isn't its component's least node.

    Null ends and loops are ignored; repeated links count once.  Every round is written to the shared
    folder, so neither links nor labels reach the driver; only two sums do, to see that nothing changed.
    """
    now = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first())
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = mark
        now = written(_stars(now), "stars")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels ``node, component`` after *links* (``a, b``) are added to them.

    Links are drawn between groups first, so that the rounds work on groups that grow and not on all nodes.
    """
    if not links.head(1):
        return labels
    of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_group"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_group", "a").alias("a"), F.coalesce("b_group", "b").alias("b"))
    moved = components(between).withColumnRenamed("component", "now")
    kept = labels.join(moved.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return written(kept.unionByName(moved.withColumnRenamed("now", "component")), "groups")
