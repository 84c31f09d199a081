"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Every so many rounds a label jumps to the label of its node, which shortens long chains.
JUMP = 3


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for all nodes of ``edges`` (x, y: long).

    A node's label falls to the smallest of its neighbours' and its own; now and then it jumps to
    the label of its label; until none changes. Every step is joins and aggregates on nodes,
    written to the shared folder; only whether any label changed comes to the driver.
    """
    both = keep(edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct(), "edges")
    labels = keep(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")), "labels")
    turn = 0
    while True:
        turn += 1
        told = both.join(labels.select(F.col("node").alias("y"), "label").hint("merge"), "y").select(F.col("x").alias("node"), "label", F.lit(None).cast("long").alias("own"))
        lower = told.union(labels.select("node", "label", F.col("label").alias("own"))).groupBy("node").agg(F.min("label").alias("label"), F.min("own").alias("own"))
        lower = keep(lower, "labels")
        if not lower.where("label < own").limit(1).count():
            return lower.select("node", "label")
        labels = lower.select("node", "label")
        if turn % JUMP == 0:
            up = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = keep(labels.join(up.hint("merge"), "label").select("node", F.least("label", "next").alias("label")), "labels")
