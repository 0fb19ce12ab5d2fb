"""Queries over scores, costs, filters and files: the second part of the registry."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, diagnosis, model, samplers, scoring
from ..operators import trace_queries as tq
from ..schema import DAY_US
from ..sources import folders, formats
from ..sources.tables import events_as_spans
from .queries import HEAD, INJECT_US, _error_report, _failures, _k, _q, _r, _rate_report, _scored
from .storage import shared_folder, stored

Query = Callable[[SparkSession, str], DataFrame]
#: What an approach is held to have as its identity; other columns of a filter count as metadata.
FEATURES = ("service", "operation", "kind")
#: Seconds of one core a GiB that costs are quoted at.
CPU_S_PER_GIB = 60.0
INJECTIONS = tuple(INJECT_US // DAY_US + d for d in (-5, 0, 5))
EXPLAINING = ("level", "meta_filters", "weight", "cardinality", "occurrences", "skew", "avg_depth", "shared_edge_rate")


def _analysed(s: DataFrame, h: DataFrame) -> DataFrame:
    mine = _rate_report(s, h)
    theirs = scoring.series_report(tq.rate_over_time(s), tq.rate_over_time(samplers.head(s, 2)), scale=2.0)
    totals = tq.totals(tq.rate_over_time(s))
    return analysis.failure_analysis(mine, theirs, totals, analysis.query_context(s), FEATURES)


def _sizes(s: DataFrame) -> DataFrame:
    head, kept = samplers.head(s, HEAD), samplers.tail(s)
    out = None
    for name, stored, handled in (("all", s, s), ("head_4", head, head), ("tail", kept, s), ("hindsight", kept, kept)):
        one = analysis.stored_sizes(name, stored, handled)
        out = one if out is None else out.unionByName(one)
    return out


def _fidelity_cost(s: DataFrame) -> DataFrame:
    report = None
    for name, kept, scale in (("head_4", samplers.head(s, HEAD), float(HEAD)), ("tail", samplers.tail(s), 1.0)):
        parts = {"rate": scoring.series_report(tq.rate_over_time(s), tq.rate_over_time(kept), scale=scale), "error": _error_report(s, kept)}
        for category, r in parts.items():
            one = r.select(F.lit(name).alias("approach"), F.lit(category).alias("category"), "fidelity", "weight")
            report = one if report is None else report.unionByName(one)
    return analysis.with_costs(scoring.mean_fidelity(report), analysis.approach_costs(_sizes(s), CPU_S_PER_GIB))


def _detections(s: DataFrame) -> DataFrame:
    sums = diagnosis.cusum(diagnosis.signals(s))
    out = None
    for day in INJECTIONS:
        one = diagnosis.detection(sums, day, "error", s).withColumn("scenario", F.lit(day))
        out = one if out is None else out.unionByName(one)
    return out


def _rca(s: DataFrame) -> DataFrame:
    scenarios = s.select("service").distinct().select(F.concat("service", F.lit("_cpu")).alias("scenario"), F.col("service").alias("answer"))
    return analysis.ranking_hits(diagnosis.trace_rca(s, INJECT_US), scenarios)


def _points(s: DataFrame, h: DataFrame) -> DataFrame:
    g = scoring.graph_report(tq.graph_edges(s), tq.graph_edges(h), tq.graph_nodes(s), tq.graph_nodes(h), scale=float(HEAD))
    return g.agg(
        F.count(F.lit(1)).alias("times"), F.percentile("fidelity", 0.5).alias("median"), F.avg("fidelity").alias("mean"), F.stddev_pop("fidelity").alias("population_deviation")
    )


def _vocabulary_delta(s: DataFrame) -> DataFrame:
    before = model.node_vocabulary(s.where("NOT error_trace"))
    return analysis.vocabulary_delta(before, model.extended(before, s)).select("bucket", F.translate("feature", "\0", ";").alias("feature"), F.col("node_idx").cast("bigint").alias("node_idx"))


def _importance(s: DataFrame, h: DataFrame) -> DataFrame:
    return analysis.feature_importance(stored(_analysed(s, h), "analysed"), EXPLAINING)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _read_back(rows: DataFrame) -> DataFrame:
    return rows.select("trace_id", "span_id", "parent_span_id", "service", "operation", "kind", "status", "start_us", "dur_us", F.col("attrs")["k"].alias("k"))


def otlp_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans written as OTLP JSON lines and read back."""
    path = _folder(spark, "otlp")
    formats.write_otlp(events_as_spans(spark, sf_dir), path, 8)
    return _read_back(formats.read_otlp_json(spark, path))


def jaeger_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans written as a Jaeger document a trace and read back, a document a line."""
    path = _folder(spark, "jaeger")
    folders.jaeger_documents(events_as_spans(spark, sf_dir)).select("value").write.text(path)
    return _read_back(formats.read_jaeger(spark, path, lines=True))


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans written as trace CSV and read back."""
    path = _folder(spark, "csv")
    folders.csv_rows(events_as_spans(spark, sf_dir), ("k",)).write.option("header", True).csv(path)
    return _read_back(formats.read_trace_csv(spark, path))


def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages over a folder of two scenarios with three runs each: events dealt by user."""
    path = _folder(spark, "runs")
    s = events_as_spans(spark, sf_dir)
    rows = stored(folders.csv_rows(s, ("k",)).select("*", F.pmod(F.substring_index("traceID", "-", 1).cast("bigint"), F.lit(6)).alias("part")), "runs")
    for i in range(6):
        one = rows.where(F.col("part") == i).drop("part")
        one.write.option("header", True).csv(f"{path}/{'cart_cpu' if i < 3 else 'pay_delay'}/{i % 3 + 1}/traces.csv")
    return folders.run_averages(folders.scenario_runs(spark, path))


def analysis_queries() -> dict[str, Query]:
    return {
        "dashboard": _q(lambda s: _r(analysis.dashboard(s), "error_rate", "p50", "p95", "p99")),
        "names_over_time": _q(analysis.names_over_time),
        "matching_spans": _q(lambda s: analysis.matching(s, "kind:CLIENT!@#operation:k1").select("span_id")),
        "query_context": _k(lambda s: _r(analysis.query_context(s), "avg_depth", "shared_edge_rate")),
        "failure_analysis": _scored(lambda s, h: _r(_analysed(s, h), "skew", "avg_depth", "shared_edge_rate", "fidelity", "their_fidelity", "delta")),
        "failure_histogram": _scored(lambda s, h: analysis.histogram(_failures(s, h), "delta", -100.0, 100.0, 20)),
        "feature_importance": _scored(_importance),
        "sampler_sizes": _q(_sizes),
        "sampler_costs": _q(lambda s: _r(analysis.approach_costs(_sizes(s), CPU_S_PER_GIB), "cpu_s", "dollars", digits=9)),
        "fidelity_cost": _q(lambda s: _r(_r(_fidelity_cost(s), "mean", "weighted", digits=5), "dollars", digits=9)),
        "rca_hits": _q(lambda s: _r(_rca(s), "hit_fidelity")),
        "rca_points": _q(lambda s: _r(analysis.scenario_summary(_rca(s), ("ac1", "ac3", "ac5", "hit_fidelity")), "mean", "deviation", "population_deviation", digits=5)),
        "anomaly_summary": _q(
            lambda s: _r(analysis.scenario_summary(_detections(s), ("detected", "delay", "false_alarms", "false_alarm_rate", "ac1", "ac5")), "mean", "deviation", "population_deviation", digits=5)
        ),
        "graph_likeness": _scored(
            lambda s, h: _r(analysis.graph_likeness(tq.graph_edges(s), tq.graph_edges(h), tq.graph_nodes(s), tq.graph_nodes(h)), "distance", "fidelity")
        ),
        "graph_points": _scored(lambda s, h: _r(_points(s, h), "median", "mean", "population_deviation", digits=5)),
        "attribute_draws": _q(lambda s: analysis.attribute_draws(samplers.head(s, HEAD), s, "k").select("span_id", "value")),
        "vocabulary_delta": _q(_vocabulary_delta),
        "otlp_scan": otlp_scan,
        "jaeger_scan": jaeger_scan,
        "csv_scan": csv_scan,
        "run_statistics": lambda spark, sf_dir: _r(run_statistics(spark, sf_dir), "window_s", digits=3),
    }
