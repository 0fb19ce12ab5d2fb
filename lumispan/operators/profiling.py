"""What a data set is like: which attributes matter for durations, which to model, how offsets are best modelled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expressions import clamp
from .model import MEMORISED
from .tree import with_parent


def attribute_effect(spans: DataFrame, columns: tuple[str, ...], target: str = "dur_us", least: int = 5) -> DataFrame:
    """Effect size of each column on the target within a feature: Kruskal and Wallis' H, corrected for ties, as
    eta squared = H / (n - 1), weighted by n over the features. Values with fewer than ``least`` rows are left out,
    and features with a single value left.

    Ranks come from counts per distinct target, so a scan orders distinct values.
    """
    long = spans.select(
        "feature", F.col(target).alias("y"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), (F.col("attrs")[c] if c not in spans.columns else F.col(c).cast("string")).alias("value")) for c in columns])).alias("a"),
    ).select("feature", "y", "a.attribute", "a.value").where("value <> ''")
    c = long.groupBy("feature", "attribute", "value", "y").agg(F.count(F.lit(1)).alias("c"))
    size = W.partitionBy("feature", "attribute", "value")
    c = c.withColumn("g", F.sum("c").over(size)).where(F.col("g") >= least)
    ties = c.groupBy("feature", "attribute", "y").agg(F.sum("c").alias("t"))
    run = W.partitionBy("feature", "attribute").orderBy("y")
    ties = ties.withColumn("rank", F.sum("t").over(run) - (F.col("t") - 1) / 2.0)
    correction = ties.groupBy("feature", "attribute").agg(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"), F.sum("t").alias("n"))
    sums = c.join(ties.drop("t"), ["feature", "attribute", "y"]).groupBy("feature", "attribute", "value").agg(
        F.sum("c").alias("k"), F.sum(F.col("c") * F.col("rank")).alias("r")
    )
    h = sums.groupBy("feature", "attribute").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("r") * F.col("r") / F.col("k")).alias("s"))
    h = h.where("groups >= 2").join(correction, ["feature", "attribute"])
    n = F.col("n").cast("double")
    raw = 12.0 / (n * (n + 1)) * F.col("s") - 3.0 * (n + 1)
    fixed = 1.0 - F.col("ties") / (n * n * n - n)
    eta = F.when(fixed > 0, F.greatest(F.lit(0.0), raw / fixed / (n - 1))).otherwise(0.0)
    e = h.withColumn("eta", eta)
    return e.groupBy("attribute").agg(
        F.count(F.lit(1)).alias("features"), F.sum("n").alias("n"), (F.sum(F.col("eta") * F.col("n")) / F.sum("n")).alias("eta2")
    )


def promoted(effect: DataFrame, threshold: float = 0.06) -> DataFrame:
    """Attributes that deserve to be part of a span's identity."""
    return effect.where(F.col("eta2") > threshold)


def discovered(stats: DataFrame, primary: tuple[str, ...], coverage: float) -> DataFrame:
    """Attributes that enough spans have and that aren't primary: candidates to be modelled."""
    return stats.where((F.col("coverage") >= coverage) & ~F.col("name").isin(*primary))


def offset_models(a: DataFrame) -> DataFrame:
    """How well a line over the position predicts gaps: as a ratio of the parent's duration and as a logarithm.

    Per model: pairs, and the mean over pairs of the median and the 90th percentile of the relative error. Pairs of at
    most 20 samples are memorised and count as exact.
    """
    p = with_parent(a.drop("p_span_id"), ["feature", "start_us", "dur_us"], "inner").where("p_dur_us > 0")
    gap = (F.col("start_us") - F.col("p_start_us")).cast("double")
    s = p.select("bucket", "p_feature", "feature", F.col("normal_position").alias("x"), gap.alias("gap"), F.col("p_dur_us").alias("d"))
    target = F.explode(F.array(
        F.struct(F.lit("ratio").alias("model"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("gap") / F.col("d"))).alias("y")),
        F.struct(F.lit("log").alias("model"), F.log1p(F.greatest(F.lit(0.0), F.col("gap"))).alias("y")),
    ))
    s = s.select("*", target.alias("t")).select("bucket", "p_feature", "feature", "x", "gap", "d", "t.model", "t.y")
    key = ["bucket", "p_feature", "feature", "model"]
    f = s.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when((F.col("n") < 5) | (F.abs(det) < 1e-9), 0.0).otherwise((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / det)
    f = f.select(*key, "n", slope.alias("b1"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("b0"))
    s = s.join(f, key)
    y = F.col("b0") + F.col("b1") * F.col("x")
    predicted = F.when(F.col("model") == "ratio", F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)) * F.col("d")).otherwise(F.expm1(F.greatest(F.lit(0.0), y)))
    error = F.when(F.col("n") <= MEMORISED, 0.0).otherwise(F.abs(predicted - F.col("gap")) / F.greatest(F.abs(F.col("gap")), F.lit(1.0)))
    e = s.withColumn("e", error).groupBy(*key).agg(F.percentile("e", 0.5).alias("p50"), F.percentile("e", 0.9).alias("p90"))
    pairs = e.groupBy("p_feature", "feature", "model").agg(F.avg("p50").alias("p50"), F.avg("p90").alias("p90"))
    return pairs.groupBy("model").agg(F.count(F.lit(1)).alias("pairs"), F.avg("p50").alias("p50"), F.avg("p90").alias("p90"))


def offset_percentiles(a: DataFrame) -> DataFrame:
    """How well lines over the position return the distribution of gaps and durations, as ratios of the parent's duration
    and as logarithms, within the bounds that the samples had.

    Per model: pairs, groups (bucket and pair), memorised groups, and per gap and dur the mean over pairs of the relative
    error of the median, the 90th and the 99th percentile. A group's lines are fitted on all its samples; compared are
    those of positive duration and no negative gap. Groups of at most 20 of them are memorised and count as exact.
    """
    p = with_parent(a.drop("p_span_id"), ["feature", "start_us", "dur_us"], "inner").where("p_dur_us > 0")
    key = ["bucket", "p_feature", "feature"]
    gap, dur = (F.col("start_us") - F.col("p_start_us")).cast("double"), F.col("dur_us").cast("double")
    s = p.select(*key, F.col("normal_position").alias("x"), gap.alias("gap"), dur.alias("dur"), F.col("p_dur_us").cast("double").alias("d"))
    held = {y: F.greatest(F.lit(0.0), F.col(y)) for y in ("gap", "dur")}
    targets = {("ratio", y): v / F.col("d") for y, v in held.items()} | {("log", y): F.log1p(v) for y, v in held.items()}
    x, sums = F.col("x"), [F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx")]
    for (m, y), v in targets.items():
        sums += [F.sum(v).alias(f"s_{m}_{y}"), F.sum(x * v).alias(f"sx_{m}_{y}")]
    valid = (F.col("dur") > 0) & (F.col("gap") >= 0)
    for y in ("gap", "dur"):
        sums += [F.min(F.when(valid, F.col(y))).alias(f"{y}_lo"), F.max(F.when(valid, F.col(y))).alias(f"{y}_hi")]
    f = s.groupBy(*key).agg(*sums, F.sum(valid.cast("bigint")).alias("valid"))
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    for m, y in targets:
        slope = F.when((F.col("n") < 2) | (F.abs(det) < 1e-15), 0.0).otherwise((F.col("n") * F.col(f"sx_{m}_{y}") - F.col("sx") * F.col(f"s_{m}_{y}")) / det)
        f = f.withColumn(f"b1_{m}_{y}", slope).withColumn(f"b0_{m}_{y}", (F.col(f"s_{m}_{y}") - F.col(f"b1_{m}_{y}") * F.col("sx")) / F.col("n"))
    s = s.where(valid).join(f, key)
    line = {(m, y): F.col(f"b0_{m}_{y}") + F.col(f"b1_{m}_{y}") * x for m, y in targets}
    d, one = F.col("d"), F.lit(1.0)
    inside = lambda v, y: clamp(v, F.col(f"{y}_lo"), F.col(f"{y}_hi"))
    share = {y: clamp(inside(clamp(line["ratio", y], F.lit(0.0), one) * d, y) / d, F.lit(0.0), one) for y in held}
    both = share["gap"] + share["dur"]
    back = {("ratio", y): F.when(both > 1, share[y] / both).otherwise(share[y]) * d for y in held}
    back |= {("log", y): clamp(inside(F.exp(clamp(line["log", y], F.lit(0.0), F.lit(30.0))) - 1, y), F.lit(0.0), d) for y in held}
    exact = F.col("valid") <= MEMORISED
    rows = s.select(*key, "valid", "gap", "dur", *[
        F.when(exact, F.col(y)).otherwise(F.greatest(v, one) if y == "dur" else v).alias(f"{m}_{y}") for (m, y), v in back.items()
    ])
    at = F.array(*[F.lit(q) for q in (0.5, 0.9, 0.99)])
    g = rows.groupBy(*key).agg(F.max("valid").alias("valid"), *[F.percentile(c, at).alias(c) for c in ("gap", "dur", *[f"{m}_{y}" for m, y in back])])
    error = lambda m, y, i: F.when(F.get(y, F.lit(i)) > 0, F.abs(F.get(f"{m}_{y}", F.lit(i)) - F.get(y, F.lit(i))) / F.get(y, F.lit(i))).otherwise(0.0)
    names = [(y, i, f"{y}_{q}") for y in ("gap", "dur") for i, q in enumerate(("p50", "p90", "p99"))]
    each = [F.struct(F.lit(m).alias("model"), *[error(m, y, i).alias(n) for y, i, n in names]) for m in ("ratio", "log")]
    g = g.select(*key, "valid", F.explode(F.array(*each)).alias("e")).select(*key, "valid", "e.*")
    pairs = g.groupBy("p_feature", "feature", "model").agg(
        F.count(F.lit(1)).alias("groups"), F.sum((F.col("valid") <= MEMORISED).cast("bigint")).alias("memorised"), *[F.avg(n).alias(n) for *_, n in names]
    )
    return pairs.groupBy("model").agg(F.count(F.lit(1)).alias("pairs"), F.sum("groups").alias("groups"), F.sum("memorised").alias("memorised"), *[F.avg(n).alias(n) for *_, n in names])


def edge_cover(spans: DataFrame) -> DataFrame:
    """How often each edge of node names occurs among the spans' ancestors, once per span: parent, child, weight."""
    from .trace_queries import node_name
    from .tree import closure

    named = spans.withColumn("node", node_name())
    edge = with_parent(named, ["node"], "inner").select("trace_id", F.col("span_id").alias("ancestor"), F.col("p_node").alias("parent"), F.col("node").alias("child"))
    own = edge.select("trace_id", F.col("ancestor").alias("span_id"), "parent", "child")
    above = closure(spans).join(edge, ["trace_id", "ancestor"]).select("trace_id", "span_id", "parent", "child")
    return own.unionByName(above).distinct().groupBy("parent", "child").agg(F.count(F.lit(1)).alias("weight"))
