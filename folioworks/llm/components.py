"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import scratch_dir, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link.

    Each round hooks the current label of a node to the smallest label next to
    it and then follows the labels once more (pointer jumping), so that long
    chains take a logarithmic number of rounds.  Rounds are written to the
    shared folder, which cuts the lineage.  A hub's links are only ever
    aggregated with partial minima, never gathered.
    """
    base = scratch_dir(links.sparkSession)
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = both.union(both.select("v", "u")).filter("u <> v").distinct()
    both = stored(both, f"{base}/links")
    labels = both.groupBy("u").agg(F.min("v").alias("v")).select(
        F.col("u").alias("node"), F.least("u", "v").alias("component"))
    turn = 0
    labels = stored(labels, f"{base}/labels-0")
    while True:
        named = both.join(labels.select(F.col("node").alias("v"), F.col("component").alias("near")), "v")
        lowest = named.groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        # A label learns of a smaller one next to any of its nodes.
        seen = labels.join(lowest, "node").select("node", "component", F.least("component", "near").alias("low"))
        root = seen.groupBy("component").agg(F.min("low").alias("root"))
        hooked = seen.join(root, "component").select(
            "node", F.col("component").alias("was"), F.least("low", "root").alias("component"))
        jump = root.select(F.col("component").alias("at"), F.col("root").alias("further"))
        moved = hooked.join(jump, F.col("component") == F.col("at"), "left").select(
            "node", "was", F.least("component", F.coalesce("further", "component")).alias("component"))
        turn += 1
        moved = stored(moved, f"{base}/labels-{turn}")
        labels = moved.select("node", "component")
        if moved.filter("was <> component").isEmpty():
            return labels
