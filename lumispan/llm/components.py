"""Connected components by contraction, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b): node and component, its least node.

    Every node points at its least neighbour or itself, edges move to what their ends point at,
    and the graph of the targets is treated alike until no edge is left. Each round is two joins
    and a grouped minimum whose partial sums run before the shuffle, so a hub of many edges is
    spread; nothing is collected.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    mapping: DataFrame | None = None
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        target = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m"))
        target = written(target.select("node", F.least("node", "_m").alias("component")), "targets")
        if mapping is None:
            mapping = target
        else:
            step = target.select(F.col("node").alias("component"), F.col("component").alias("_next"))
            mapping = mapping.join(step, "component", "left").select(
                "node", F.coalesce("_next", "component").alias("component")
            )
            mapping = written(mapping, "mapping")
        left = target.select(F.col("node").alias("a"), F.col("component").alias("_a"))
        right = target.select(F.col("node").alias("b"), F.col("component").alias("_b"))
        moved = edges.join(left, "a").join(right, "b").where("_a <> _b")
        moved = moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        edges = written(moved, "edges")
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return mapping
