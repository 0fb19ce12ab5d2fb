"""What stands behind scores: where a filter's spans sit in their traces, what approaches store and handle, summaries
over scenarios, graph comparisons, feature importance, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expressions import PAIR, cost_dollars, filter_level, group_keys, span_entries
from ..plans.storage import stored
from ..schema import PRIMARY
from .scoring import failures, sibling_skew
from .tree import closure, rooted, with_parent


def dashboard(spans: DataFrame, time: str = "bucket") -> DataFrame:
    """Per time and service: spans, error rate, and the exact median, 95th and 99th percentile of durations, from counts
    per duration."""
    c = spans.groupBy(time, "service", "dur_us").agg(F.count(F.lit(1)).alias("c"), F.sum((F.col("status") == "2").cast("bigint")).alias("e"))
    p = F.percentile("dur_us", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.col("c"))
    g = c.groupBy(time, "service").agg(F.sum("c").alias("n"), F.sum("e").alias("e"), p.alias("p"))
    return g.select(time, "service", "n", (F.col("e") / F.col("n")).alias("error_rate"), *[F.get("p", i).alias(x) for i, x in enumerate(("p50", "p95", "p99"))])


def names_over_time(spans: DataFrame, time: str = "bucket") -> DataFrame:
    return spans.groupBy(time, "operation").agg(F.count(F.lit(1)).alias("n"))


def matching(spans: DataFrame, key: str) -> DataFrame:
    """The spans that a group key selects: all of them, or those that hold every column:value it names. A column that is
    not a span's own is looked up in its attributes."""
    if key == "all":
        return spans
    for part in key.split(PAIR):
        name, _, value = part.partition(":")
        spans = spans.where((F.col(name).cast("string") if name in spans.columns else F.col("attrs")[name]) == value)
    return spans


def depths(spans: DataFrame, r: DataFrame | None = None) -> DataFrame:
    """trace_id, span_id, depth, where a missing parent has depth 0: an orphan starts at 1. ``r`` is what ``rooted`` gave for
    the same spans, where it is known."""
    r = rooted(spans) if r is None else r
    lost = spans.select("trace_id", F.col("span_id").alias("root"), F.when(F.coalesce("parent_span_id", F.lit("")) != "", 1).otherwise(0).alias("_lost"))
    return r.join(lost, ["trace_id", "root"]).select("trace_id", "span_id", (F.col("depth") + F.col("_lost")).alias("depth"))


def query_context(spans: DataFrame, columns: tuple[str, ...] = PRIMARY, attributes: tuple[str, ...] | None = ()) -> DataFrame:
    """Per group key: spans, avg_depth, and shared_edge_rate = 1 - (how often its spans pass edges) / (how often all spans pass
    the same edges); 0 where its spans pass none. An edge is a pair of features and counts once per span.

    All spans of one set of entries answer to the same keys, so depths and passes are summed per set before keys are
    expanded.
    """
    sets = spans.withColumn("_set", span_entries({c: F.col(c) for c in columns}, F.col("attrs"), attributes))
    own = stored(sets.select("trace_id", "span_id", "feature", "_set"), "entry_sets")
    keys = F.explode(group_keys(F.col("_set"))).alias("group_key")
    roots = rooted(spans)
    d = own.join(depths(spans, roots), ["trace_id", "span_id"]).groupBy("_set").agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("d"))
    depth = d.select("n", "d", keys).groupBy("group_key").agg(F.sum("n").alias("n"), (F.sum("d") / F.sum("n")).alias("avg_depth"))
    edge = with_parent(spans, ["feature"], "inner").select("trace_id", F.col("span_id").alias("ancestor"), F.md5(F.concat("p_feature", F.lit("\x01"), "feature")).alias("edge"))
    passed = edge.select("trace_id", F.col("ancestor").alias("span_id"), "edge").unionByName(
        closure(spans, roots).join(edge, ["trace_id", "ancestor"]).select("trace_id", "span_id", "edge")
    )
    passed = passed.distinct().join(own, ["trace_id", "span_id"])
    per = stored(passed.groupBy("_set", "edge").agg(F.count(F.lit(1)).alias("w")), "passed_edges")
    whole = per.groupBy("edge").agg(F.sum("w").alias("all"))
    shared = per.select("edge", "w", keys).groupBy("group_key", "edge").agg(F.sum("w").alias("w")).join(whole, "edge")
    shared = shared.groupBy("group_key").agg((1.0 - F.sum("w") / F.sum("all")).alias("shared_edge_rate"))
    return depth.join(shared, "group_key", "left").withColumn("shared_edge_rate", F.coalesce("shared_edge_rate", F.lit(0.0)))


def filter_type(key: Column, features: tuple[str, ...]) -> Column:
    """F for each column of a key that is one of the features, M for others, joined by ';'; '-' for 'all'."""
    part = F.transform(F.split(key, PAIR), lambda p: F.when(F.substring_index(p, ":", 1).isin(*features), "F").otherwise("M"))
    return F.when(filter_level(key) == 0, "-").otherwise(F.array_join(part, ";"))


def failure_analysis(mine: DataFrame, theirs: DataFrame, totals: DataFrame, context: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Rows of ``failures`` with what may explain them: level, filter_type, how many of its filters aren't features, cardinality,
    occurrences and skew among its siblings, depth and shared edges."""
    f = failures(mine, theirs).withColumns({"level": filter_level(F.col("group_key")), "filter_type": filter_type(F.col("group_key"), features)})
    f = f.withColumn("meta_filters", F.length(F.regexp_replace("filter_type", "[^M]", "")).cast("bigint"))
    last = F.substring_index("group_key", PAIR, -1)
    rest = F.when(F.col("group_key").contains(PAIR), F.substring_index("group_key", PAIR, 1))
    f = f.withColumn("prefix", F.when(F.col("level") > 0, F.concat_ws(PAIR, rest, F.substring_index(last, ":", 1))))
    return f.join(sibling_skew(totals), "prefix", "left").join(context.drop("n"), "group_key", "left").select(
        "group_key", "level", "filter_type", "meta_filters", "weight", "cardinality", "occurrences", "skew",
        F.coalesce("avg_depth", F.lit(-1.0)).alias("avg_depth"), F.coalesce("shared_edge_rate", F.lit(-1.0)).alias("shared_edge_rate"),
        "fidelity", "their_fidelity", "delta", "place",
    )


def failure_sections(sections: dict[tuple[str, str], tuple[DataFrame, DataFrame]], totals: DataFrame, context: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """``failure_analysis`` of several sections (query type, percentile or '-'), each a report of its own and one of what it is
    held against, with the share of a key's filters that aren't features."""
    totals, context, out = stored(totals, "totals"), stored(context, "context"), None
    for (kind, percentile), (mine, theirs) in sections.items():
        one = failure_analysis(mine, theirs, totals, context, features).select(F.lit(kind).alias("query_type"), F.lit(percentile).alias("percentile"), "*")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("meta_ratio", F.when(F.col("level") > 0, F.col("meta_filters") / F.col("level")).otherwise(0.0))


def histogram(rows: DataFrame, column: str, lo: float, hi: float, bins: int, worst: int = 20) -> DataFrame:
    """Rows per bin of a column, for all rows and for the ``worst`` ones; values beyond the ends are in the end bins."""
    bin_ = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(column) - lo) / (hi - lo) * bins))).cast("bigint")
    both = rows.withColumn("scope", F.lit("all")).unionByName(rows.where(F.col("place") <= worst).withColumn("scope", F.lit("worst")))
    return both.groupBy("scope", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def span_bytes() -> Column:
    """What a span takes: its texts, its attributes' values, and two numbers."""
    text = ["trace_id", "span_id", "parent_span_id", "service", "operation", "kind", "status"]
    held = F.coalesce(F.map_values("attrs"), F.array().cast("array<string>"))
    extra = F.aggregate(held, F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(F.octet_length(v), F.lit(0)))
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text), extra + 16)


def stored_sizes(approach: str, kept: DataFrame, handled: DataFrame, time: str = "bucket") -> DataFrame:
    """Per time: the spans and bytes that an approach stores, and the bytes that it had to look at for that."""
    size = span_bytes()
    one = lambda d, n: d.groupBy(time).agg(F.count(F.lit(1)).alias(f"{n}_spans"), F.sum(size).cast("bigint").alias(f"{n}_bytes"))
    both = one(handled, "handled").join(one(kept, "stored"), time, "left").na.fill(0)
    return both.select(F.lit(approach).alias("approach"), time, "stored_spans", "stored_bytes", "handled_bytes")


def approach_costs(sizes: DataFrame, cpu_s_per_gib: float) -> DataFrame:
    """Per approach: what it stores, handles and costs. Handling is priced at the seconds a GiB that were measured for it."""
    s = sizes.groupBy("approach").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("stored_spans", "stored_bytes", "handled_bytes")])
    cpu = F.col("handled_bytes") / float(1 << 30) * cpu_s_per_gib
    return s.withColumn("cpu_s", cpu).withColumn("dollars", cost_dollars(F.col("stored_bytes"), F.col("cpu_s"), F.lit(0.0)))


def with_costs(fidelity: DataFrame, costs: DataFrame) -> DataFrame:
    """Fidelity per approach beside its cost; an approach without a known cost costs 0."""
    return fidelity.join(costs.select("approach", "dollars"), "approach", "left").withColumn("dollars", F.coalesce("dollars", F.lit(0.0)))


def scenario_summary(rows: DataFrame, metrics: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Per metric (and ``by``): scenarios that have it, mean, sample deviation and population deviation."""
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x"))
    g = long.where("x.v IS NOT NULL").groupBy(*by, "x.metric")
    return g.agg(
        F.count(F.lit(1)).alias("n"), F.avg("x.v").alias("mean"), F.coalesce(F.stddev_samp("x.v"), F.lit(0.0)).alias("deviation"),
        F.stddev_pop("x.v").alias("population_deviation"),
    )


def ranking_hits(ranking: DataFrame, scenarios: DataFrame, most: int = 5) -> DataFrame:
    """Per scenario (scenario, answer): is the answer among the first k services, for k up to ``most``, and the share of k for
    which it is, in percent."""
    r = scenarios.join(ranking.select(F.col("service").alias("answer"), "rank"), "answer", "left")
    hit = [F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int").alias(f"ac{k}") for k in range(1, most + 1)]
    r = r.select("scenario", "answer", *hit)
    return r.withColumn("hit_fidelity", sum((F.col(f"ac{k}") for k in range(2, most + 1)), F.col("ac1")) * 100.0 / most)


def graph_likeness(base: DataFrame, other: DataFrame, base_nodes: DataFrame, other_nodes: DataFrame, time: str = "bucket") -> DataFrame:
    """Per time of the base: the edit distance of two graphs held against the base's nodes and the weights of both."""
    keys = [time, "parent", "child"]
    e = base.select(*keys, F.col("weight").cast("double").alias("_a")).join(other.select(*keys, F.col("weight").cast("double").alias("_b")), keys, "full").na.fill(0.0, ["_a", "_b"])
    e = e.groupBy(time).agg(F.sum(F.abs(F.col("_a") - F.col("_b"))).alias("_e"), F.sum(F.col("_a") + F.col("_b")).alias("_w"))
    n = base_nodes.withColumn("_x", F.lit(1)).join(other_nodes.withColumn("_y", F.lit(1)), [time, "node"], "full").na.fill(0, ["_x", "_y"])
    n = n.groupBy(time).agg(F.sum((F.col("_x") != F.col("_y")).cast("int")).alias("_n"), F.sum("_x").alias("_m")).where("_m > 0")
    j = n.join(e, time, "left").na.fill(0.0, ["_e", "_w"])
    d = F.col("_n") + F.col("_e")
    return j.select(time, d.alias("distance"), F.greatest(F.lit(0.0), 100.0 - 100.0 * d / (F.col("_m") + F.col("_w"))).alias("fidelity"))


def attribute_draws(fit: DataFrame, spans: DataFrame, attribute: str, seed: int = 42) -> DataFrame:
    """trace_id, span_id, value: a value of the attribute drawn per span from those that spans of its service and operation
    had in ``fit``, in proportion; from those of all spans where the pair is new."""
    from ..functions.expressions import uniform
    from .draws import draw_table, drawn

    seen = fit.select("service", "operation", F.coalesce(F.col("attrs")[attribute], F.lit("")).alias("value"))
    n = seen.groupBy("service", "operation", "value").agg(F.count(F.lit(1)).alias("n"))
    pairs = draw_table(n, ["service", "operation"], ["value"], "n")
    everywhere = draw_table(n.groupBy("value").agg(F.sum("n").alias("n")).withColumn("_k", F.lit(0)), ["_k"], ["value"], "n", "_any").drop("_k")
    u = uniform("attribute", F.lit(attribute), F.lit(seed), F.col("span_id"))
    s = spans.select("trace_id", "span_id", "service", "operation").join(pairs, ["service", "operation"], "left").crossJoin(everywhere)  # one row
    return s.select("trace_id", "span_id", F.coalesce(drawn(u), drawn(u, "_any"))["value"].alias("value"))


def boosted(rows: DataFrame, features: tuple[str, ...], target: str = "delta", trees: int = 20, seed: int = 42):
    """Boosted trees of depth four over the features, missing ones as 0, and the rows that they were fitted on."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    r = rows.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in (*features, target)])
    r = VectorAssembler(inputCols=list(features), outputCol="features").transform(r)
    return GBTRegressor(labelCol=target, maxIter=trees, maxDepth=4, seed=seed).fit(r), r


def feature_importance(rows: DataFrame, features: tuple[str, ...], target: str = "delta", seed: int = 42) -> DataFrame:
    """Per feature: its share of the gains of boosted trees, and its weight in a linear model of standardised columns."""
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.regression import LinearRegression

    model, r = boosted(rows, features, target, seed=seed)
    r = r.withColumnRenamed("features", "raw")
    r = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(r).transform(r)
    line = LinearRegression(labelCol=target, standardization=False).fit(r).coefficients.toArray()
    found = [(f, float(a), float(b)) for f, a, b in zip(features, model.featureImportances.toArray(), line, strict=True)]
    return rows.sparkSession.createDataFrame(found, "feature string, importance double, coefficient double")


def ablations(primary: tuple[str, ...], dependent: tuple[str, ...] = ()) -> list[tuple[str, tuple[str, ...], tuple[str, ...]]]:
    """Per primary attribute: its name, the primary attributes without it, the dependent ones with it."""
    return [(p, tuple(x for x in primary if x != p), (*dependent, p)) for p in primary]


def vocabulary_delta(vocabulary: DataFrame, extended: DataFrame) -> DataFrame:
    """The entries that a vocabulary gained, by their numbers."""
    return extended.join(vocabulary, ["bucket", "feature", "node_idx"], "left_anti")
