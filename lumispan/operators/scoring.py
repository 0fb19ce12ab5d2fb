"""How well an approach reproduces the base: reports per group and time, costs, failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expressions import PAIR, cost_dollars, fidelity, filter_level, symmetric_error


def series_report(base: DataFrame, other: DataFrame, value: str = "n", time: str = "bucket", scale: float = 1.0) -> DataFrame:
    """Per group key of the base: mean symmetric error over the times that both have, and the fidelity. A group
    that the other lacks, or shares no time with, has fidelity 0; groups of the other alone don't count."""
    o = other.select("group_key", F.col(time).alias("_t"), (F.col(value) * scale).alias("_o"))
    both = base.join(o.withColumnRenamed("group_key", "_g"), (F.col("group_key") == F.col("_g")) & (F.col(time) == F.col("_t")), "left")
    error = F.avg(F.when(F.col("_o").isNotNull(), symmetric_error(F.col(value).cast("double"), F.col("_o").cast("double"))))
    rows = both.groupBy("group_key").agg(error.alias("mape"), F.sum(value).alias("weight"))
    return rows.select(
        "group_key", F.coalesce("mape", F.lit(100.0)).alias("mape"),
        F.when(F.col("mape").isNull(), 0.0).otherwise(fidelity(F.col("mape"))).alias("fidelity"), "weight",
    )


def cosine_report(base: DataFrame, other: DataFrame, value: str = "n", time: str = "bucket") -> DataFrame:
    """Per group key: cosine of the two series over common times; with one common time, whether they are equal."""
    o = other.select("group_key", time, F.col(value).alias("_o"))
    a, b = F.col(value).cast("double"), F.col("_o").cast("double")
    both = base.join(o, ["group_key", time]).groupBy("group_key").agg(
        F.count(F.lit(1)).alias("times"), F.sum(a * b).alias("ab"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"),
        F.max(a).alias("xa"), F.max(b).alias("xb"),
    )
    many = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / (F.sqrt("aa") * F.sqrt("bb"))).otherwise(0.0)
    return both.select("group_key", "times", F.when(F.col("times") == 1, (F.col("xa") == F.col("xb")).cast("double")).otherwise(many).alias("cosine"))


def graph_report(
    base: DataFrame, other: DataFrame, base_nodes: DataFrame, other_nodes: DataFrame, time: str = "bucket",
    scale: float = 1.0, binary: bool = False,
) -> DataFrame:
    """Per time of the base: edit distance of the dependency graphs (a node 1, an edge the difference of its weights)
    and the fidelity against the base's nodes and weights; 0 where the other lacks the time."""
    keys = [time, "parent", "child"]
    weight = lambda x: (F.lit(1.0) if binary else F.col("weight") * x).alias
    a = base.select(*keys, weight(1.0)("_a"))
    b = other.select(*keys, weight(1.0 if binary else scale)("_b"))
    edges = a.join(b, keys, "full").groupBy(time).agg(
        F.sum(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))).alias("_e"), F.sum(F.coalesce("_a", F.lit(0.0))).alias("_w")
    )
    na, nb = base_nodes.withColumn("_x", F.lit(1)), other_nodes.withColumn("_y", F.lit(1))
    nodes = na.join(nb, [time, "node"], "full").groupBy(time).agg(
        F.sum((F.col("_x").isNull() | F.col("_y").isNull()).cast("int")).alias("_n"), F.sum(F.coalesce("_x", F.lit(0))).alias("_m"), F.max("_y").alias("_has")
    )
    d = F.col("_n") + F.coalesce("_e", F.lit(0.0))
    size = F.col("_m") + F.coalesce("_w", F.lit(0.0))
    score = F.when(F.col("_has").isNull(), 0.0).when(size > 0, F.greatest(F.lit(0.0), 100.0 - 100.0 * d / size)).otherwise(0.0)
    return nodes.join(edges, time, "left").where("_m > 0").select(time, d.alias("distance"), score.alias("fidelity"))


def wasserstein(base: DataFrame, other: DataFrame, value: str) -> DataFrame:
    """One row: the area between the two distributions of ``value``. Distinct values are counted first."""
    one = lambda d, c: d.groupBy(value).agg(F.count(F.lit(1)).cast("double").alias(c))
    s = one(base, "_a").join(one(other, "_b"), value, "full").na.fill(0.0, ["_a", "_b"])
    order, whole = W.orderBy(value), W.partitionBy(F.lit(1))
    gap = F.abs(F.sum("_a").over(order) / F.sum("_a").over(whole) - F.sum("_b").over(order) / F.sum("_b").over(whole))
    step = F.lead(value).over(order) - F.col(value)
    return s.select((gap * step).alias("area")).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("distance"))


def costs(approaches: DataFrame) -> DataFrame:
    """Add dollars to rows of approach, bytes, cpu_s, gpu_s."""
    return approaches.withColumn("dollars", cost_dollars(F.col("bytes"), F.col("cpu_s"), F.col("gpu_s")))


def scorecard(report: DataFrame) -> DataFrame:
    """From approach, category, seed, fidelity: n, mean, min, max, and the deviation over the seeds' means."""
    seeds = report.groupBy("approach", "category", "seed").agg(F.avg("fidelity").alias("m"))
    spread = seeds.groupBy("approach", "category").agg(F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("deviation"))
    all_ = report.groupBy("approach", "category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("fidelity").alias("mean"), F.min("fidelity").alias("least"), F.max("fidelity").alias("most")
    )
    return all_.join(spread, ["approach", "category"])


def mean_fidelity(report: DataFrame) -> DataFrame:
    """Per approach: the mean of the categories' means, and the mean weighted by counts."""
    per = report.groupBy("approach", "category").agg(F.avg("fidelity").alias("m"), F.sum(F.col("fidelity") * F.col("weight")).alias("s"), F.sum("weight").alias("w"))
    return per.groupBy("approach").agg(F.avg("m").alias("mean"), (F.sum("s") / F.sum("w")).alias("weighted"))


def level_means(report: DataFrame) -> DataFrame:
    """Fidelity by the number of attributes that a group key names: weighted by counts, and plain."""
    r = report.withColumn("level", filter_level(F.col("group_key")))
    return r.groupBy("level").agg(
        F.count(F.lit(1)).alias("groups"), (F.sum(F.col("fidelity") * F.col("weight")) / F.sum("weight")).alias("weighted"), F.avg("fidelity").alias("mean")
    )


def failures(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Per group key that both report: how far the first falls behind, worst first by ``place``."""
    t = theirs.select("group_key", F.col("fidelity").alias("their_fidelity"))
    d = mine.join(t, "group_key").withColumn("delta", F.col("fidelity") - F.col("their_fidelity"))
    # Ranks over group keys: their number follows the configured attributes, not the spans.
    return d.withColumn("place", F.row_number().over(W.orderBy(F.round("delta", 9), "group_key")))


def sibling_skew(totals: DataFrame) -> DataFrame:
    """Per filter prefix (a group key without its last value): values, spans, skew (1 - entropy / log values)."""
    last = F.substring_index("group_key", PAIR, -1)
    rest = F.when(F.col("group_key").contains(PAIR), F.substring_index("group_key", PAIR, 1))
    prefix = F.concat_ws(PAIR, rest, F.substring_index(last, ":", 1))
    t = totals.where("group_key <> 'all'").select(prefix.alias("prefix"), "n")
    t = t.withColumn("_p", F.col("n") / F.sum("n").over(W.partitionBy("prefix")))
    g = t.groupBy("prefix").agg(F.count(F.lit(1)).alias("cardinality"), F.sum("n").alias("occurrences"), (-F.sum(F.col("_p") * F.log("_p"))).alias("_h"))
    return g.select("prefix", "cardinality", "occurrences", F.when(F.col("cardinality") > 1, 1.0 - F.col("_h") / F.log("cardinality")).otherwise(1.0).alias("skew"))


def distribution(failures_: DataFrame, column: str, worst: int = 20) -> DataFrame:
    """Mean and median of a column over all rows and over the ``worst`` ones."""
    both = failures_.withColumn("scope", F.lit("all")).unionByName(failures_.where(F.col("place") <= worst).withColumn("scope", F.lit("worst")))
    return both.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean"), F.percentile(column, 0.5).alias("median"))
