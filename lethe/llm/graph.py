"""Connected components of an edge table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long): root is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then the
    label's own label, until no label changes; chains halve with every round.  All
    joins deal hot nodes over sub-keys, and every round is written to the shared
    folder, so lineage stays short.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("root")), "cc-labels")
    while True:
        ends = labels.select(F.col("node").alias("b"), F.col("root").alias("r"))
        nearest = attach(both, ends, ["b"], ["a"]).groupBy("a").agg(F.min("r").alias("m"))
        step = materialize(labels.join(nearest, F.col("node") == F.col("a"), "left").select(
            "node", F.col("root").alias("old"), F.least("root", "m").alias("root")), "cc-step")
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("above"))
        labels = materialize(attach(step, jump, ["root"], ["node"]).select(
            "node", "old", F.least("root", "above").alias("root")), "cc-labels")
        if labels.filter("old != root").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
