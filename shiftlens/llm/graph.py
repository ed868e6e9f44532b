"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.session import materialize


def components(links: DataFrame) -> DataFrame:
    """Return (node, root): root is the smallest node that links of (a, b) can reach.

    Each round points every node at its smallest neighbour, follows the pointers a few steps and
    contracts what they join, so rounds grow with the logarithm of the longest path. Only linked
    nodes appear. Lineage is cut by a written table in every round.
    """
    edges = materialize(links.select("a", "b").filter("a <> b").distinct())
    found = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        up = both.groupBy("node").agg(F.min("other").alias("up"))
        up = materialize(up.select("node", F.least("node", "up").alias("up")))
        for _ in range(2):
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = up.join(above, "up").select("node", F.col("top").alias("up"))
        up = materialize(up)
        end = lambda name: up.select(F.col("node").alias(name), F.col("up").alias(f"{name}_up"))  # noqa: E731, B023
        edges = materialize(
            edges.join(end("a"), "a").join(end("b"), "b")
            .select(F.col("a_up").alias("a"), F.col("b_up").alias("b"))
            .filter("a <> b").distinct()
        )
        if found is None:
            found = up.select("node", F.col("up").alias("root"))
        else:
            step = up.select(F.col("node").alias("root"), "up")
            found = found.join(step, "root", "left").select(
                "node", F.coalesce("up", "root").alias("root")
            )
        found = materialize(found)
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
