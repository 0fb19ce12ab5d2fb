"""Trees of spans: parents, positions, roots, depths, ancestors, templates, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.storage import stored


def with_parent(spans: DataFrame, columns: list[str], how: str = "left") -> DataFrame:
    """Add p_span_id and p_<column> of each span's parent in the same trace."""
    spans = spans.drop("p_span_id", *[f"p_{c}" for c in columns])
    p = spans.select(
        F.col("trace_id").alias("_t"), F.col("span_id").alias("p_span_id"), *[F.col(c).alias(f"p_{c}") for c in columns]
    )
    return spans.join(p, (F.col("trace_id") == F.col("_t")) & (F.col("parent_span_id") == F.col("p_span_id")), how).drop("_t")


def orphans(spans: DataFrame) -> DataFrame:
    """Spans that name a parent which their trace lacks."""
    p = spans.select("trace_id", F.col("span_id").alias("parent_span_id"))
    return spans.where(F.col("parent_span_id").isNotNull()).join(p, ["trace_id", "parent_span_id"], "left_anti")


def positioned(spans: DataFrame) -> DataFrame:
    """Add position (from 0 among siblings by start, then id), siblings (0 for roots and orphans),
    normal_position (position / (siblings - 1), 0 for an only child) and child_count."""
    s = with_parent(spans, [])
    child = F.col("p_span_id").isNotNull()
    kin = W.partitionBy("trace_id", "p_span_id")
    rank = F.row_number().over(kin.orderBy("start_us", "span_id")) - 1
    number = F.count(F.lit(1)).over(kin)
    counts = spans.where(F.col("parent_span_id").isNotNull()).groupBy("trace_id", F.col("parent_span_id").alias("span_id"))
    counts = counts.agg(F.count(F.lit(1)).alias("child_count"))
    return (
        s.withColumn("position", F.when(child, rank).otherwise(0).cast("bigint"))
        .withColumn("siblings", F.when(child, number).otherwise(0).cast("bigint"))
        .withColumn(
            "normal_position", F.when(F.col("siblings") > 1, F.col("position") / (F.col("siblings") - 1)).otherwise(0.0)
        )
        .join(counts, ["trace_id", "span_id"], "left")
        .withColumn("child_count", F.coalesce("child_count", F.lit(0)).cast("bigint"))
    )


def rooted(spans: DataFrame) -> DataFrame:
    """Per span: trace_id, span_id, root (of its component) and depth (0 at roots and orphans).

    Pointers double: each round a span looks at the span it points to and points where that one
    points, so a tree of depth d takes log2(d) joins. Spans on a cycle never end and are left out.
    """
    s = with_parent(spans, []).select(
        "trace_id",
        "span_id",
        F.coalesce("p_span_id", "span_id").alias("root"),
        F.when(F.col("p_span_id").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
        F.col("p_span_id").isNull().alias("done"),
    )
    left = -1
    while True:
        s = stored(s, "pointers")
        # Depths have no gaps: a round that ends no span leaves only cycles and what hangs on them.
        before, left = left, s.where(~F.col("done")).count()
        if left in (0, before):
            break
        up = s.select(
            F.col("trace_id"), F.col("span_id").alias("root"), F.col("root").alias("_r"), F.col("depth").alias("_d"), F.col("done").alias("_o")
        )
        s = s.join(up, ["trace_id", "root"]).select(
            "trace_id",
            "span_id",
            F.col("_r").alias("root"),
            F.when(F.col("done"), F.col("depth")).otherwise(F.col("depth") + F.col("_d")).alias("depth"),
            (F.col("done") | F.col("_o")).alias("done"),
        )
    return s.where("done").drop("done")


def closure(spans: DataFrame, ended: DataFrame | None = None) -> DataFrame:
    """Every span with each of its ancestors: trace_id, span_id, ancestor, distance. Spans on or below a cycle are left out;
    ``ended`` is what ``rooted`` gave for the same spans, where it is known.

    Reach doubles: those that are exactly as far as the pairs reach take on the pairs of their ancestor, so a tree of
    depth d takes log2(d) joins.
    """
    ended = (rooted(spans) if ended is None else ended).select("trace_id", "span_id")
    parent = with_parent(spans.join(ended, ["trace_id", "span_id"], "left_semi"), [], "inner")
    out = stored(parent.select("trace_id", "span_id", F.col("p_span_id").alias("ancestor"), F.lit(1).cast("bigint").alias("distance")), "parents")
    reach = 1
    while True:
        up = out.select("trace_id", F.col("span_id").alias("ancestor"), F.col("ancestor").alias("_next"), F.col("distance").alias("_d"))
        further = out.where(F.col("distance") == reach).join(up, ["trace_id", "ancestor"]).select(
            "trace_id", "span_id", F.col("_next").alias("ancestor"), (F.col("distance") + F.col("_d")).alias("distance")
        )
        further = stored(further, "ancestors")
        if further.isEmpty():
            return out
        out, reach = out.unionByName(further), 2 * reach


def component_sizes(spans: DataFrame) -> DataFrame:
    """Per component of a trace: trace_id, root, span_count."""
    return rooted(spans).groupBy("trace_id", "root").agg(F.count(F.lit(1)).alias("span_count"))


def templates(spans: DataFrame) -> DataFrame:
    """Per root: trace_id, root, template (its tree in breadth-first order as depth, feature and child
    count of each node), nodes (the same as structs), size. Siblings stand in order of their positions."""
    p = positioned(spans)
    kin = stored(p.select("trace_id", "span_id", "feature", "child_count", "position"), "kin")
    roots = rooted(spans)
    path = closure(spans, roots).join(
        kin.select("trace_id", F.col("span_id").alias("ancestor"), F.col("position").alias("_p")), ["trace_id", "ancestor"]
    )
    above = path.groupBy("trace_id", "span_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), F.col("_p").alias("p")))).alias("_a")
    )
    rows = kin.join(above, ["trace_id", "span_id"], "left").join(roots, ["trace_id", "span_id"])
    above_ = F.transform(F.coalesce("_a", F.array().cast("array<struct<d:bigint,p:bigint>>")), lambda x: x["p"])
    key = F.concat(above_, F.array("position"))
    node = F.struct("depth", key.alias("path"), F.struct("depth", "feature", "child_count").alias("node"))
    trees = rows.groupBy("trace_id", "root").agg(
        F.transform(F.array_sort(F.collect_list(node)), lambda x: x["node"]).alias("nodes"), F.count(F.lit(1)).alias("size")
    )
    text = F.array_join(F.transform("nodes", lambda x: F.concat_ws("|", x["depth"], x["feature"], x["child_count"])), ";")
    return trees.select("trace_id", "root", text.alias("template"), "nodes", "size")


def paths(spans: DataFrame, length: int = 5) -> DataFrame:
    """The features of each span and the ``length`` - 1 spans above it, topmost first, where there are so many."""
    p = with_parent(spans, []).select("trace_id", "span_id", "p_span_id", "feature")
    out = p.select("trace_id", "span_id", F.col("p_span_id").alias("_up"), F.array("feature").alias("path"))
    step = p.select("trace_id", F.col("span_id").alias("_up"), F.col("p_span_id").alias("_next"), F.col("feature").alias("_f"))
    for _ in range(length - 1):
        out = out.join(step, ["trace_id", "_up"]).select(
            "trace_id", "span_id", F.col("_next").alias("_up"), F.concat(F.array("_f"), "path").alias("path")
        )
    return out.select("trace_id", "span_id", "path")


def unique_edges(spans: DataFrame) -> DataFrame:
    """Edges (parent feature, position, child feature) and how often each occurs."""
    p = with_parent(positioned(spans.drop("p_span_id")).drop("p_span_id"), ["feature"], "inner")
    return p.groupBy(F.col("p_feature").alias("parent_feature"), "position", "feature").agg(F.count(F.lit(1)).alias("n"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """Parents for rows that have depth only: row i of depth d hangs under row i mod n of depth d - 1."""
    w = W.partitionBy("trace_id", "depth")
    r = rows.withColumn("_i", F.row_number().over(w.orderBy("span_id")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    up = r.select("trace_id", (F.col("depth") + 1).alias("depth"), F.col("_i").alias("_slot"), F.col("span_id").alias("parent_span_id"), F.col("_n").alias("_m"))
    sizes = up.select("trace_id", "depth", "_m").distinct()
    r = r.drop("parent_span_id", "_n").join(sizes, ["trace_id", "depth"], "left")
    r = r.withColumn("_slot", F.pmod("_i", F.coalesce("_m", F.lit(1)))).drop("_m")
    return r.join(up.drop("_m"), ["trace_id", "depth", "_slot"], "left").drop("_i", "_slot")
