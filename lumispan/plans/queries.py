"""The registered queries: operators over spans adapted from the tables, time buckets of a day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import group_entries, group_keys
from ..operators import diagnosis, generate, model, normalise, profiling, samplers, scoring, tree
from ..operators import trace_queries as tq
from ..schema import DAY_US, PRIMARY, ModelConfig
from ..sources.tables import conversations_as_spans, events_as_spans, orders_as_spans
from .storage import stored

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = ModelConfig(bucket_us=DAY_US, dependent=("k",))
#: The approach that scored queries hold against the base: one trace in four.
HEAD = 4
#: 2024-01-15, the moment that diagnosis queries take as the injection.
INJECT_US = 1_705_276_800_000_000


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.derived(events_as_spans(spark, sf_dir), DAY_US)


def kept_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans, stored: queries that read them more than once don't derive them again."""
    return stored(spans(spark, sf_dir), "spans")


def _q(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(spans(spark, sf_dir))


def _k(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(kept_spans(spark, sf_dir))


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round what floats differ in between engines."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _a(f: Callable[[DataFrame], DataFrame]) -> Query:
    return _k(lambda s: f(model.annotated(s)))


def _pairs(f: Callable[[DataFrame], DataFrame]) -> Query:
    return _a(lambda a: f(model.pair_samples(a, CONFIG)))


def _scored(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return _k(lambda s: f(s, samplers.head(s, HEAD)))


def _graph(binary: bool) -> Query:
    def run(s: DataFrame, h: DataFrame) -> DataFrame:
        out = scoring.graph_report(tq.graph_edges(s), tq.graph_edges(h), tq.graph_nodes(s), tq.graph_nodes(h), scale=float(HEAD), binary=binary)
        return _r(out, "distance", "fidelity")

    return _scored(run)


def _rate_report(s: DataFrame, h: DataFrame) -> DataFrame:
    return scoring.series_report(tq.rate_over_time(s), tq.rate_over_time(h), scale=float(HEAD))


def _error_report(s: DataFrame, h: DataFrame) -> DataFrame:
    return scoring.series_report(tq.errors_over_time(s), tq.errors_over_time(h))


def _duration_report(s: DataFrame, h: DataFrame) -> DataFrame:
    a, b = tq.durations_over_time(s), tq.durations_over_time(h)
    out = None
    for p in ("p50", "p90", "p99"):
        one = scoring.series_report(a, b, p).drop("weight").withColumn("percentile", F.lit(p))
        out = one if out is None else out.unionByName(one)
    return out


def _report(s: DataFrame, h: DataFrame) -> DataFrame:
    parts = {"rate": _rate_report(s, h), "error": _error_report(s, h)}
    out = None
    for name, r in parts.items():
        one = r.select(F.lit("head_4").alias("approach"), F.lit(name).alias("category"), F.lit(0).alias("seed"), "fidelity", "weight")
        out = one if out is None else out.unionByName(one)
    return out


def _failures(s: DataFrame, h: DataFrame) -> DataFrame:
    other = samplers.head(s, 2)
    mine = _rate_report(s, h)
    theirs = scoring.series_report(tq.rate_over_time(s), tq.rate_over_time(other), scale=2.0)
    return scoring.failures(mine, theirs)


def _percentile_rows(p: DataFrame) -> DataFrame:
    x = p.select("bucket", "parent", "feature", "n", F.posexplode(F.arrays_zip("gap_p", "dur_p")).alias("i", "x"))
    return x.select("bucket", "parent", "feature", "n", "i", F.col("x.gap_p").alias("gap"), F.col("x.dur_p").alias("dur"))


def _generated(config: ModelConfig) -> Query:
    return _k(lambda s: generate.generate(model.train(s, config)))


def _sampled_ids(f: Callable[[DataFrame], DataFrame]) -> Query:
    return _q(lambda s: f(s).select("trace_id", "span_id"))


def _cost(s: DataFrame, h: DataFrame) -> DataFrame:
    size = lambda d, name: d.agg(F.sum(F.length("trace_id") + F.length("span_id") + 16).cast("bigint").alias("bytes")).select(
        F.lit(name).alias("approach"), "bytes", F.lit(3600.0).alias("cpu_s"), F.lit(0.0).alias("gpu_s"))
    return _r(scoring.costs(size(s, "all").unionByName(size(h, "head_4"))), "dollars", digits=9)


def _tree_sizes(adapter: Callable) -> Query:
    return lambda spark, sf_dir: tree.component_sizes(adapter(spark, sf_dir)).groupBy("span_count").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    from .analysis_queries import analysis_queries
    from .model_queries import model_queries

    return trace_query_table() | analysis_queries() | model_queries()


def trace_query_table() -> dict[str, Query]:
    fixed = ["trace_id", "span_id", "parent_span_id", "service", "operation", "kind", "status", "start_us", "dur_us"]
    return {
        "duration_percentiles": _q(lambda s: _r(tq.durations_over_time(s), "p50", "p90", "p99")),
        "spans_flat": _q(lambda s: s.select(*fixed, "has_parent", "bucket", "error_trace", F.col("attrs")["k"].alias("k"))),
        "trace_summary": _q(lambda s: s.groupBy("trace_id", "bucket").agg(F.count(F.lit(1)).alias("spans"), F.min("start_us").alias("start_us"), F.max("error_trace").alias("error_trace"))),
        "feature_vocab": _a(lambda a: model.node_vocabulary(a).select("bucket", F.translate("feature", "\0", ";").alias("feature"), F.col("node_idx").cast("bigint").alias("node_idx"))),
        "group_keys": _q(lambda s: s.select(F.explode(group_keys(group_entries({c: F.col(c) for c in PRIMARY}))).alias("group_key")).groupBy("group_key").agg(F.count(F.lit(1)).alias("n"))),
        "rate_over_time": _q(tq.rate_over_time),
        "rate_totals": _q(lambda s: tq.totals(tq.rate_over_time(s))),
        "error_over_time": _q(tq.errors_over_time),
        "service_graph_edges": _q(tq.graph_edges),
        "service_graph_nodes": _q(tq.graph_nodes),
        "span_count": _k(tree.component_sizes),
        "span_count_orders": _tree_sizes(orders_as_spans),
        "span_count_conversations": _tree_sizes(conversations_as_spans),
        "span_depth": _k(lambda s: tree.rooted(s).select("span_id", "root", "depth")),
        "ancestors": _k(lambda s: tree.closure(s).select("span_id", "ancestor", "distance")),
        "flat_spans": _k(tq.flat_spans),
        "child_position": _a(lambda a: _r(a.select("span_id", "position", "siblings", "normal_position", "child_count"), "normal_position")),
        "error_traces": _q(lambda s: s.where("error_trace").select("trace_id").distinct()),
        "orphan_stats": _q(tq.orphan_stats),
        "column_stats": _q(lambda s: _r(tq.column_stats(s), "coverage")),
        "dataset_basics": _q(tq.basics),
        "child_sets": _k(lambda s: _r(tq.child_sets(s).withColumn("feature", F.translate("feature", "\0", ";")), "top_set_share", "top_multiset_share")),
        "templates": _k(lambda s: tree.templates(s).groupBy("template", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("template", F.md5(F.translate("template", "\0", ",")))),
        "unique_edges": _k(lambda s: tree.unique_edges(s).select(*[F.translate(c, "\0", ";").alias(c) for c in ("parent_feature", "feature")], "position", "n")),
        "paths": _k(lambda s: tree.paths(s, 3).select("span_id", F.translate(F.array_join("path", ">"), "\0", ";").alias("path"))),
        "start_table": _a(lambda a: model.start_table(a).withColumn("feature", F.translate("feature", "\0", ";"))),
        "topology_edges": _a(lambda a: _r(model.topology_edges(a).withColumns({c: F.translate(c, "\0", ";") for c in ("feature", "parent")}), "probability")),
        "duration_bounds": _a(lambda a: model.duration_bounds(a).withColumn("feature", F.translate("feature", "\0", ";"))),
        "gap_bounds": _a(lambda a: model.gap_bounds(a).withColumn("feature", F.translate("feature", "\0", ";"))),
        "root_duration_stats": _a(lambda a: _r(model.root_duration_stats(a).withColumn("feature", F.translate("feature", "\0", ";")), "mean", "variance", digits=5)),
        "root_gmm": _a(lambda a: model.root_durations(a, CONFIG)),
        "pair_ols": _pairs(lambda p: _r(model.pair_regression(p).withColumns({c: F.translate(c, "\0", ";") for c in ("feature", "parent")}), "gap_beta0", "gap_beta1", "dur_beta0", "dur_beta1")),
        "pair_percentiles": _pairs(lambda p: _r(_percentile_rows(model.pair_percentiles(p).withColumns({c: F.translate(c, "\0", ";") for c in ("feature", "parent")})), "gap", "dur")),
        "pair_memorised": _pairs(lambda p: _r(model.pair_memorised(p).withColumns({c: F.translate(c, "\0", ";") for c in ("feature", "parent")}).select("bucket", "parent", "feature", "n", "gap", "dur"), "gap", "dur")),
        "attr_categorical": _pairs(lambda p: _r(model.attribute_shares(p, "k").withColumns({c: F.translate(c, "\0", ";") for c in ("feature", "parent")}), "probability")),
        "bucket_meta": _a(model.bucket_meta),
        "model_size": _k(lambda s: model.train(s, CONFIG).sizes()),
        "generated_spans": _generated(CONFIG),
        "generated_percentile": _generated(ModelConfig(bucket_us=DAY_US, offset_model="percentile")),
        "generated_templates": _generated(ModelConfig(bucket_us=DAY_US, topology_mode="template", dependent=("k",))),
        "head_sample": _sampled_ids(lambda s: samplers.head(s, HEAD)),
        "tail_classes": _q(lambda s: samplers.classified(s)),
        "tail_sample": _sampled_ids(samplers.tail),
        "hindsight_sample": _sampled_ids(samplers.hindsight),
        # Conversations, whose paths have up to eight spans; those of events have four.
        "sifter_sample": lambda spark, sf_dir: samplers.sifter(normalise.derived(conversations_as_spans(spark, sf_dir), DAY_US), HEAD),
        "gzip_size": _q(samplers.gzip_bytes),
        "arrow_size": _q(samplers.arrow_bytes),
        "service_stats": _q(lambda s: _r(diagnosis.service_stats(s), "mean_us", digits=4)),
        "ks_by_service": _q(lambda s: _r(diagnosis.ks_distance(s.where(F.col("start_us") >= INJECT_US), s.where(F.col("start_us") < INJECT_US)), "ks", digits=9)),
        "trace_rca": _q(lambda s: _r(diagnosis.trace_rca(s, INJECT_US), "error_rate", "ks", "score")),
        "call_graph": _q(diagnosis.call_graph),
        "micro_rank": _q(lambda s: diagnosis.micro_rank(s, INJECT_US)),
        "cusum": _q(lambda s: _r(diagnosis.cusum(diagnosis.signals(s)), "up", "down", "size", digits=5)),
        "anomaly_localise": _q(lambda s: _r(diagnosis.localised(diagnosis.cusum(diagnosis.signals(s))), "size", digits=5)),
        "detection_report": _q(lambda s: _r(diagnosis.detection(diagnosis.cusum(diagnosis.signals(s)), INJECT_US // DAY_US, "error", s), "false_alarm_rate")),
        "attribute_eta2": _q(lambda s: _r(profiling.attribute_effect(s.withColumn("feature", F.col("service")), ("operation", "kind", "k")), "eta2")),
        "attribute_discovery": _q(lambda s: _r(profiling.discovered(tq.column_stats(s), PRIMARY, 0.5), "coverage")),
        "offset_models": _a(lambda a: _r(profiling.offset_models(a), "p50", "p90", digits=5)),
        "edge_cover": _q(profiling.edge_cover),
        "report_rate": _scored(lambda s, h: _r(_rate_report(s, h), "mape", "fidelity")),
        "report_error": _scored(lambda s, h: _r(_error_report(s, h), "mape", "fidelity")),
        "report_duration": _scored(lambda s, h: _r(_duration_report(s, h), "mape", "fidelity")),
        "report_graph": _graph(False),
        "report_graph_binary": _graph(True),
        "report_span_count": _scored(lambda s, h: _r(scoring.wasserstein(tree.component_sizes(s), tree.component_sizes(h), "span_count"), "distance")),
        "cosine_fidelity": _scored(lambda s, h: _r(scoring.cosine_report(tq.rate_over_time(s), tq.rate_over_time(h)), "cosine")),
        "scorecard": _scored(lambda s, h: _r(scoring.scorecard(_report(s, h)), "mean", "least", "most", "deviation", digits=5)),
        "mean_fidelity": _scored(lambda s, h: _r(scoring.mean_fidelity(_report(s, h)), "mean", "weighted", digits=5)),
        "level_means": _scored(lambda s, h: _r(scoring.level_means(_rate_report(s, h)), "mean", "weighted", digits=5)),
        "cost": _scored(_cost),
        "failure_rows": _scored(lambda s, h: _r(_failures(s, h), "mape", "fidelity", "their_fidelity", "delta")),
        "sibling_skew": _q(lambda s: _r(scoring.sibling_skew(tq.totals(tq.rate_over_time(s))), "skew")),
        "envelope_repair": _q(lambda s: normalise.envelope_repaired(s).select("span_id", "start_us", "dur_us")),
        "remap": _q(lambda s: normalise.remapped(s, DAY_US).select("span_id", "start_us", "dur_us")),
        "max_traces": _q(lambda s: normalise.subsampled(s, 100).select("span_id")),
        "chunks": _q(lambda s: normalise.chunks(s, 100).select("span_id", "chunk")),
    }
