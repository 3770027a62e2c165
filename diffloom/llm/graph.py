"""Connected components of link tables (distributed union-find on DataFrames).

Rounds of contraction: every node points at its smallest neighbour or itself, links
move to the nodes pointed at, and links inside a node vanish.  Rounds take the order of
ids and a fresh pseudo-random order in turn: a star around its smallest id, the usual
group of copies, is done in one round, and with random orders the number of nodes that
have links falls by a constant share, so long chains take logarithmically many rounds.
Every round is written to the shared folder, which cuts the lineage and lets later
joins split hot nodes.  Nothing but row counts of zero or more reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.storage import stored


def _links(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of all nodes of ``links(a, b)``."""
    left = stored(links.select(*_links(F.col("a"), F.col("b"))).where("a < b").distinct())
    labels, turn = None, 0
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
            left.select("b", "a")
        )
        rank = (lambda c: c) if turn % 2 == 0 else (lambda c, t=turn: F.xxhash64(c, F.lit(t)))
        near = ends.groupBy("node").agg(F.min_by("other", F.struct(rank(F.col("other")), "other")).alias("other"))
        heads = stored(
            near.select(
                "node",
                F.when(
                    F.struct(rank(F.col("other")), F.col("other"))
                    < F.struct(rank(F.col("node")), F.col("node")),
                    F.col("other"),
                ).otherwise(F.col("node")).alias("head"),
            )
        )
        of_a = heads.select(F.col("node").alias("a"), F.col("head").alias("_a"))
        of_b = heads.select(F.col("node").alias("b"), F.col("head").alias("_b"))
        left = stored(
            left.join(of_a, "a").join(of_b, "b").select(*_links(F.col("_a"), F.col("_b")))
            .where("a < b").distinct()
        )
        if labels is None:
            labels = heads.withColumnRenamed("head", "label")
        else:
            moved = heads.withColumnRenamed("node", "label")
            labels = stored(
                labels.join(moved, "label", "left").select(
                    "node", F.coalesce("head", "label").alias("label")
                )
            )
        turn += 1
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if turn == 1:
        return labels.withColumnRenamed("label", "component")
    smallest = stored(labels.groupBy("label").agg(F.min("node").alias("component")))
    return stored(labels.join(smallest, "label").select("node", "component"))
