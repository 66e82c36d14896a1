"""Connected components of a link table, as repeated joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchops.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links(a, b)``; label is the smallest
    node reachable.

    In each round a node takes its smallest neighbour, if that is smaller,
    as label, and then twice the label of its label; links are rewritten to
    labels, and those inside one label go.  Labels never rise and the
    smallest node of a component keeps its own, so when no link is left all
    nodes of a component have that one.  Links at least halve in most
    rounds.  Every round is a written table, so a lost executor costs one
    round's tasks only."""
    left = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    label = None
    while left.count():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("near")).union(left.select("b", "a"))
        step = materialize(ends.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("label")), "labels")
        for _ in range(2):
            further = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            step = materialize(step.join(further, "label").select("node", F.col("next").alias("label")), "labels")
        moved = left.join(step.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
        moved = moved.join(step.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb")
        left = materialize(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links")
        if label is None:
            label = step
        else:
            further = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            label = materialize(label.join(further, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
    return label if label is not None else left.select(F.col("a").alias("node"), F.col("b").alias("label"))
