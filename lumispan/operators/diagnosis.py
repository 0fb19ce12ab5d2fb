"""Finding what went wrong: service statistics, distribution distance, rankings, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.storage import stored
from .tree import with_parent

BASELINE_POINTS = 11
SLACK, ALARM = 0.5, 5.0


def service_stats(spans: DataFrame) -> DataFrame:
    return spans.groupBy("service").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum((F.col("status") == "2").cast("bigint")).alias("errors"),
        F.avg("dur_us").alias("mean_us"),
    )


def ks_distance(fault: DataFrame, base: DataFrame) -> DataFrame:
    """Per service: the largest gap of the two duration distributions, in the stepwise form that compares
    before a step is taken and lets the fault side go first on ties. Services without base rows get 0.

    Durations are counted first, so the ordered scan of a service sees distinct values. Of c equal
    values at once the gaps along the way are linear, so the first and last of them suffice.
    """
    one = lambda d, side: d.groupBy("service", "dur_us").agg(F.count(F.lit(1)).alias("c")).withColumn("side", F.lit(side))
    both = one(fault, 0).unionByName(one(base, 1))
    w = W.partitionBy("service").orderBy("dur_us", "side").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("service")
    n = lambda side: F.sum(F.when(F.col("side") == side, F.col("c")).otherwise(0))
    s = both.select(
        "service", "side", "c",
        F.coalesce(n(0).over(w), F.lit(0)).alias("i"), F.coalesce(n(1).over(w), F.lit(0)).alias("j"),
        n(0).over(whole).alias("na"), n(1).over(whole).alias("nb"),
    ).where("na > 0 AND nb > 0")

    def gap(k: Column) -> Column:
        i = F.col("i") + F.when(F.col("side") == 0, k).otherwise(0)
        j = F.col("j") + F.when(F.col("side") == 1, k).otherwise(0)
        a = F.when(i < F.col("na"), (i + 1) / F.col("na")).otherwise(1.0)
        b = F.when(j < F.col("nb"), (j + 1) / F.col("nb")).otherwise(1.0)
        return F.abs(a - b)

    found = s.groupBy("service").agg(F.max(F.greatest(gap(F.lit(0)), gap(F.col("c") - 1))).alias("ks"))
    return fault.select("service").distinct().join(found, "service", "left").select(
        "service", F.coalesce("ks", F.lit(0.0)).alias("ks")
    )


def trace_rca(spans: DataFrame, inject_us: int | None) -> DataFrame:
    """Services by half their error rate plus half their distance from before the injection; empty without one."""
    if inject_us is None:
        spans, inject_us = spans.limit(0), 0
    fault, base = spans.where(F.col("start_us") >= inject_us), spans.where(F.col("start_us") < inject_us)
    rate = service_stats(fault).select("service", (F.col("errors") / F.col("total")).alias("error_rate"))
    s = rate.join(ks_distance(fault, base), "service")
    s = s.withColumn("score", 0.5 * F.col("error_rate") + 0.5 * F.col("ks"))
    # One row per service: services are few, whatever the number of spans.
    return s.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("score", 12)), "service")))


def call_graph(spans: DataFrame) -> DataFrame:
    """Calls between different services: caller, callee, weight."""
    s = with_parent(spans, ["service"], "inner").where("service <> '' AND p_service <> '' AND service <> p_service")
    return s.groupBy(F.col("p_service").alias("caller"), F.col("service").alias("callee")).agg(F.count(F.lit(1)).alias("weight"))


def personalised_rank(
    nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-6
) -> DataFrame:
    """From nodes (service, preference) and edges (caller, callee, weight): service, score. Starts at the
    preference; what flows into nodes without calls is lost. Every fifth round is stored."""
    out = edges.groupBy("caller").agg(F.sum("weight").alias("_out"))
    t = stored(edges.join(out, "caller").select("caller", "callee", (F.col("weight") / F.col("_out")).alias("p")), "transitions")
    nodes = stored(nodes, "nodes")
    now = nodes.withColumn("score", F.col("preference"))
    for k in range(rounds):
        flow = now.join(t, F.col("service") == F.col("caller")).groupBy(F.col("callee").alias("service"))
        flow = flow.agg(F.sum(F.col("score") * F.col("p")).alias("_in"))
        after = now.withColumnRenamed("score", "_old").join(flow, "service", "left")
        after = after.withColumn("score", (1 - damping) * F.col("preference") + damping * F.coalesce("_in", F.lit(0.0))).drop("_in")
        if k % 5 == 4 or k == rounds - 1:
            after = stored(after, "scores")
            moved = after.agg(F.sum(F.abs(F.col("score") - F.col("_old"))).alias("d")).first()["d"] or 0.0
            now = after.drop("_old")
            if moved < tolerance:
                break
        else:
            now = after.drop("_old")
    return now.select("service", "score")


def micro_rank(spans: DataFrame, inject_us: int | None) -> DataFrame:
    """Services by a random walk on the call graph of the faulty time that restarts at suspicious services."""
    scores = trace_rca(spans, inject_us).select("service", "score")
    fault = spans.where(F.col("start_us") >= inject_us) if inject_us is not None else spans.limit(0)
    graph = call_graph(fault)
    every = scores.select("service").union(graph.select("caller")).union(graph.select("callee")).distinct()
    s = every.join(scores, "service", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    whole = W.partitionBy(F.lit(1))
    total, n = F.sum("score").over(whole), F.count(F.lit(1)).over(whole)
    nodes = s.select("service", F.when(total > 0, F.col("score") / total).otherwise(1.0 / n).alias("preference"))
    ranked = personalised_rank(nodes, graph)
    return ranked.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), "service")))


def signals(spans: DataFrame, time: str = "bucket") -> DataFrame:
    """Per service and time: log of the mean and of the 95th percentile of durations."""
    g = spans.groupBy("service", time).agg(F.avg("dur_us").alias("m"), F.percentile("dur_us", 0.95).alias("q"))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(c).alias("v")) for n, c in (("mean", "m"), ("p95", "q"))]))
    return g.select("service", F.col(time).alias("time"), pairs.alias("x")).where("x.v > 0").select(
        "service", "time", "x.signal", F.log("x.v").alias("value")
    )


def cusum(series: DataFrame, keys: tuple[str, ...] = ("service", "signal")) -> DataFrame:
    """Two-sided cumulative sums of each series (keys, time, value) against its first points, which are the baseline and
    nothing else: sums run over the points after them.

    Returns keys, time, up, down, size (the larger of up and -down), alarm; both sums restart after an alarm. A series
    of no more points than the baseline, or without spread in it, has no rows. One sorted array per series is folded: a
    series has a value per time bucket.
    """
    order = W.partitionBy(*keys).orderBy("time")
    numbered = series.withColumn("_n", F.row_number().over(order))
    base = numbered.where(F.col("_n") <= BASELINE_POINTS).groupBy(*keys)
    base = base.agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"), F.count(F.lit(1)).alias("_c"))
    base = base.where((F.col("_c") == BASELINE_POINTS) & (F.col("_s") > 0)).drop("_c")
    points = numbered.where(F.col("_n") > BASELINE_POINTS).join(base, list(keys)).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("time", ((F.col("value") - F.col("_m")) / F.col("_s")).alias("z")))).alias("_p")
    )
    point = "struct<time:bigint,up:double,down:double,size:double,alarm:boolean>"
    start = F.array(F.struct(F.lit(0).cast("bigint").alias("time"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(0.0).alias("size"), F.lit(False).alias("alarm")))

    def step(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        up = F.greatest(F.lit(0.0), F.when(last["alarm"], 0.0).otherwise(last["up"]) + p["z"] - SLACK)
        down = F.least(F.lit(0.0), F.when(last["alarm"], 0.0).otherwise(last["down"]) + p["z"] + SLACK)
        size = F.greatest(up, -down)
        row = F.struct(p["time"].cast("bigint").alias("time"), up.alias("up"), down.alias("down"), size.alias("size"), (size > ALARM).alias("alarm"))
        return F.concat(done, F.array(row))

    folded = points.select(*keys, F.explode(F.slice(F.aggregate("_p", start.cast(f"array<{point}>"), step), 2, 1 << 30)).alias("x"))
    return folded.select(*keys, "x.*")


def localised(sums: DataFrame) -> DataFrame:
    """Services with an alarm, by the largest sum that raised one."""
    s = sums.where("alarm").groupBy("service").agg(F.max("size").alias("size"), F.min("time").alias("first_alarm"))
    return s.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("size", 9)), "service")))


def detection(sums: DataFrame, inject: int, answer: str, spans: DataFrame | None = None, time: str = "bucket") -> DataFrame:
    """One row: detected (the first alarm comes no earlier than inject - 1), delay (where detected), false alarms (before
    inject - 1), their rate over the times of ``spans`` before the injection, hit at 1 to 5. An injection outside the
    times of ``spans`` is never detected and has no false alarms. Without spans the times are those of the sums."""
    ranks = localised(sums).where(F.col("service") == answer).agg(F.min("rank").alias("_r"))
    times = sums.select(F.col("time").alias("_t")) if spans is None else spans.select(F.col(time).alias("_t"))
    window = times.agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    s = sums.where("alarm").agg(F.min("time").alias("first_alarm"), F.sum((F.col("time") < inject - 1).cast("bigint")).alias("_early"))
    known = F.coalesce(F.lit(inject).between(F.col("_first"), F.col("_last")), F.lit(False))
    quiet = F.when(known, F.lit(inject) - F.col("_first")).otherwise(0)
    detected = known & F.coalesce(F.col("first_alarm") >= inject - 1, F.lit(False))
    false_alarms = F.when(known, F.coalesce("_early", F.lit(0))).otherwise(0)
    one = s.crossJoin(F.broadcast(ranks)).crossJoin(F.broadcast(window))  # a row each
    return one.select(
        "first_alarm", detected.alias("detected"),
        F.when(detected, F.col("first_alarm") - inject).cast("bigint").alias("delay"),
        false_alarms.cast("bigint").alias("false_alarms"),
        F.when(quiet > 0, false_alarms / quiet).otherwise(0.0).alias("false_alarm_rate"),
        *[F.coalesce(F.col("_r") <= k, F.lit(False)).cast("int").alias(f"ac{k}") for k in range(1, 6)],
    )


def hits(ranking: DataFrame, answer: str, most: int = 5) -> DataFrame:
    """One row: is the answer among the first k, for k up to ``most``."""
    r = ranking.where(F.col("service") == answer).agg(F.min("rank").alias("_r"))
    return r.select(*[F.coalesce(F.col("_r") <= k, F.lit(False)).cast("int").alias(f"ac{k}") for k in range(1, most + 1)])
