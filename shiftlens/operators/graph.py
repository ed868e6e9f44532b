"""Walk counts on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.operators.joins import hot_keys, lookup_join
from shiftlens.session import discard, fits_broadcast, in_parts, materialize


def path_counts(
    edges: DataFrame, source: str, steps: int, *, checkpoint_every: int = 8
) -> DataFrame:
    """Count walks of exactly ``steps`` edges from ``source`` to each node.

    Parallel edges are merged into a multiplicity first, dealt by their number so that a task's memory
    does not grow with the table. A step joins the edges with one
    frontier row per node and adds up per target, so its size is bounded by the edge table.
    The merged edges are written once for all steps. Edges that leave a hub are spread by their
    target, and the few hubs' frontier rows broadcast to them. Counts beyond 38 digits fail the query.
    """
    if steps < 0:
        raise ValueError("steps must not be negative")
    merged, hot = edges, None
    if steps:
        written = materialize(edges.select("src", "dst"))
        dealt = in_parts(written, ["src", "dst"], written.count())
        merged = materialize(dealt.groupBy("src", "dst").agg(F.count("*").alias("_m")))
        discard(written)
    if steps > 1:
        if not fits_broadcast(merged):  # else no step can have more lookup rows than a broadcast holds
            hot = materialize(hot_keys(merged, ["src"]))
            hot = None if hot.isEmpty() else hot
    frontier = edges.sparkSession.range(1).select(
        F.lit(source).alias("node"), F.lit(1).cast("decimal(38,0)").alias("walks")
    )
    for step in range(1, steps + 1):
        reach = lookup_join(
            merged, frontier.select(F.col("node").alias("src"), "walks"), ["src"], hot=hot, row_id="dst"
        )
        walks = (F.col("walks") * F.col("_m").cast("decimal(19,0)")).cast("decimal(38,0)")
        frontier = reach.groupBy(F.col("dst").alias("node")).agg(
            F.sum(walks).cast("decimal(38,0)").alias("walks")
        )
        if checkpoint_every and step % checkpoint_every == 0 and step < steps:
            frontier = materialize(frontier)
    return frontier
