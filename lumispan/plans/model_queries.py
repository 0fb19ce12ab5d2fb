"""Queries over merged, stored and delta-coded models, attribute keys and posting lists: the third part of the registry."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import hash32
from ..operators import analysis, generate, model, modes, normalise, postings, profiling, samplers, scoring, tree
from ..operators import trace_queries as tq
from ..operators.model_state import ModelState, state_of
from ..operators.measure import Timings, measured_costs
from ..operators.model_store import ModelStore
from ..operators.shapley import importance, shapley_values
from ..schema import DAY_US, PRIMARY
from ..sources import protobuf
from ..sources.formats import read_otlp_proto
from ..sources.tables import conversations_as_spans, events_as_spans
from .analysis_queries import EXPLAINING, FEATURES, _analysed, _read_back, _sizes
from .queries import CONFIG, HEAD, _k, _q, _r, _scored, kept_spans
from .storage import shared_folder, stored

Query = Callable[[SparkSession, str], DataFrame]
ATTRIBUTES = ("k",)


def _part(s: DataFrame, of: int, i: int) -> DataFrame:
    return s.where(F.pmod(hash32("part", F.col("trace_id")), F.lit(of)) == i)


def model_rows(m: model.Model) -> DataFrame:
    """A model as long rows: field, bucket, name, n and up to four numbers."""
    t = m.tables
    none = F.lit(None).cast("double")

    def rows(field: str, df: DataFrame, name: list[str], n: Column, *numbers: Column) -> DataFrame:
        text = F.translate(F.concat_ws("/", *name), "\0", ";") if name else F.lit("")
        values = [F.round(x.cast("double"), 6) for x in numbers] + [none] * (4 - len(numbers))
        return df.select(F.lit(field).alias("field"), "bucket", text.alias("name"), n.cast("bigint").alias("n"), *[v.alias(c) for v, c in zip(values, "abcd", strict=True)])

    c = F.col
    mean = F.aggregate(F.zip_with("weights", "means", lambda w, x: w * x), F.lit(0.0), lambda s, x: s + x)
    parts = [
        rows("start", t["start"], ["trace_type", "feature", "child_count"], c("n")),
        rows("edge", t["edges"], ["trace_type", "parent", "parent_count", "position", "feature", "child_count"], c("n"), c("probability")),
        rows("root", t["root_durations"], ["feature", "child_count"], c("n"), c("lo"), c("hi"), F.round(mean, 4)),
        rows("duration", t["duration_bounds"], ["feature"], F.lit(None), c("lo"), c("hi")),
        rows("gap", t["gap_bounds"], ["feature"], F.lit(None), c("lo"), c("hi")),
        rows("pair", t["pair_regression"], ["parent", "feature"], c("n"), c("gap_beta0"), c("gap_beta1"), c("dur_beta0"), c("dur_beta1")),
        rows("sample", t["pair_memorised"], ["parent", "feature"], c("n"), c("gap"), c("dur")),
        rows("meta", t["bucket_meta"], [], c("traces"), c("first_us"), c("last_us"), c("max_tree")),
        rows("k", t["attribute_k"], ["parent", "feature", "value"], c("n"), c("probability")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def model_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of two halves of the traces, trained apart, saved, read back and merged."""
    s = kept_spans(spark, sf_dir)
    path = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}"
    for i in range(2):
        state_of(_part(s, 2, i), CONFIG).save(f"{path}/{i}")
    first, second = (ModelState.load(spark, f"{path}/{i}", CONFIG) for i in range(2))
    return model_rows(first.merged(second).finalised())


def model_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of a store after a base and three extensions, with its history folded once in between."""
    s = kept_spans(spark, sf_dir)
    store = ModelStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", CONFIG)
    for i in range(4):
        store.append(state_of(_part(s, 4, i), CONFIG))
        if i == 1:
            store.compacted()
    return model_rows(store.model())


def posting_counts(s: DataFrame) -> DataFrame:
    """Every key of the rate report with its spans, from the posting lists."""
    index = postings.posting_index(s, PRIMARY, ATTRIBUTES)
    return index.counts(tq.rate_over_time(s, attributes=ATTRIBUTES).select("group_key").distinct())


def _rate_report(s: DataFrame, h: DataFrame) -> DataFrame:
    return scoring.series_report(tq.rate_over_time(s, attributes=ATTRIBUTES), tq.rate_over_time(h, attributes=ATTRIBUTES), scale=float(HEAD))


def proto_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans written as OTLP protobuf in sixteen files and read back; ids become hexadecimal first."""
    s = events_as_spans(spark, sf_dir)
    short = {c: F.when(F.col(c).isNotNull(), F.substring(F.md5(F.col(c)), 1, 16)) for c in ("span_id", "parent_span_id")}
    path = f"{shared_folder(spark)}/proto-{uuid.uuid4().hex}"
    protobuf.write_otlp_proto(s.withColumns({"trace_id": F.md5("trace_id"), **short}), path, 16)
    return _read_back(read_otlp_proto(spark, f"{path}/*.pb"))


def _approaches(s: DataFrame) -> dict[str, DataFrame]:
    return {"all": s, "head_4": samplers.head(s, HEAD), "tail": samplers.tail(s)}


def _timed(s: DataFrame) -> Timings:
    timings = Timings(s.sparkSession)
    for name, kept in _approaches(s).items():
        timings.run(name, kept, analysis.span_bytes())
    return timings


def step_timings(s: DataFrame) -> DataFrame:
    """What each approach wrote, and whether it was timed; seconds differ from run to run."""
    return _timed(s).table().select("step", "phase", "rows", "bytes", (F.col("seconds") > 0).alias("timed"))


def measured(s: DataFrame) -> DataFrame:
    """Costs of approaches at the seconds that they took."""
    return measured_costs(_sizes(s), _timed(s).table())


def scalability(s: DataFrame, scales: tuple[int, ...] = (20, 60)) -> DataFrame:
    """Per number of traces: what they are, and what training on them takes and leaves."""
    out = None
    for n in scales:
        part = normalise.derived(normalise.subsampled(s, n).select(*events_columns(s)), DAY_US)
        timings = Timings(s.sparkSession)
        raw = timings.run(f"raw_{n}", part, analysis.span_bytes())
        rows = timings.run(f"model_{n}", model_rows(state_of(raw, CONFIG).finalised()), F.octet_length(F.to_json(F.struct("*"))))
        t = timings.table().agg(F.max(F.when(F.col("step") == f"raw_{n}", F.col("bytes"))).alias("raw_bytes"), (F.min("seconds") > 0).alias("timed"))
        one = raw.agg(F.countDistinct("trace_id").alias("traces"), F.count(F.lit(1)).alias("spans")).crossJoin(t)  # a row each
        one = one.select(F.lit(n).cast("bigint").alias("n"), "traces", "spans", "raw_bytes", (F.lit(rows.count()) > 0).alias("trained"), "timed")
        out = one if out is None else out.unionByName(one)
    return out


def events_columns(s: DataFrame) -> list[str]:
    return [c for c in ("trace_id", "span_id", "parent_span_id", "service", "operation", "kind", "status", "start_us", "dur_us", "attrs") if c in s.columns]


def shapley_importance(s: DataFrame, h: DataFrame) -> DataFrame:
    rows = stored(_analysed(s, h), "analysed")
    trees, _ = analysis.boosted(rows, EXPLAINING)
    return importance(shapley_values(rows, trees, EXPLAINING, "group_key"), EXPLAINING)


def mode_normalised(s: DataFrame) -> DataFrame:
    """Durations and offsets of spans as modes and places in them."""
    columns = {"duration": F.log1p(F.greatest("dur_us", F.lit(0))), "offset": F.col("start_us") - F.col("trace_start")}
    codes, _ = modes.normalised(s, columns, ["span_id"])
    return codes.select("span_id", *[F.col(f"{c}.{x}").alias(f"{c}_{x}") for c in columns for x in ("mode", "alpha")])


def failure_sections(s: DataFrame, h: DataFrame) -> DataFrame:
    """Rate, errors and three percentiles of durations of one trace in four, held against one in two."""
    other = samplers.head(s, 2)
    durations = {n: stored(tq.durations_over_time(d), "durations") for n, d in (("base", s), ("mine", h), ("theirs", other))}
    sections = {
        ("rate", "-"): tuple(scoring.series_report(tq.rate_over_time(s), tq.rate_over_time(d), scale=x) for d, x in ((h, float(HEAD)), (other, 2.0))),
        ("error", "-"): tuple(scoring.series_report(tq.errors_over_time(s), tq.errors_over_time(d), scale=x) for d, x in ((h, float(HEAD)), (other, 2.0))),
    }
    for p in ("p50", "p90", "p99"):
        sections["duration", p] = tuple(scoring.series_report(durations["base"], durations[d], p).drop("weight").join(tq.totals(tq.rate_over_time(s)).withColumnRenamed("n", "weight"), "group_key") for d in ("mine", "theirs"))
    return analysis.failure_sections(sections, tq.totals(tq.rate_over_time(s)), analysis.query_context(s), FEATURES)


def offset_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of services over months."""
    s = normalise.derived(events_as_spans(spark, sf_dir), 30 * DAY_US, ("service",))
    out = profiling.offset_percentiles(model.annotated(s))
    return _r(out, *[c for c in out.columns if c[:4] in ("gap_", "dur_")], digits=5)


def model_queries() -> dict[str, Query]:
    return {
        "rate_by_attribute": _q(lambda s: tq.rate_over_time(s, attributes=ATTRIBUTES)),
        "error_by_attribute": _q(lambda s: tq.errors_over_time(s, attributes=ATTRIBUTES)),
        "duration_by_attribute": _q(lambda s: _r(tq.durations_over_time(s, attributes=ATTRIBUTES), "p50", "p90", "p99")),
        "report_rate_by_attribute": _q(lambda s: _r(_rate_report(s, samplers.head(s, HEAD)), "mape", "fidelity")),
        "context_by_attribute": _k(lambda s: _r(analysis.query_context(s, attributes=ATTRIBUTES), "avg_depth", "shared_edge_rate")),
        "posting_counts": _k(posting_counts),
        "model_merged": model_merged,
        "model_store": model_store,
        "proto_scan": proto_scan,
        "flat_attributes": _k(lambda s: tq.flat_spans(s, ATTRIBUTES).select("span_id", "depth", "parent_service", "siblings", "start_offset_us", "k")),
        "trace_chunks": _q(lambda s: normalise.trace_chunks(s, 50).select("span_id", "chunk")),
        "generated_counts": _k(lambda s: generate.generated_counts(model.train(s, CONFIG))),
        # The traces of eight collectors, each with a model and a warm-up of its own.
        "sifter_sharded": lambda spark, sf_dir: samplers.sifter(normalise.derived(conversations_as_spans(spark, sf_dir), DAY_US), HEAD, shards=8),
        "relay_types": _q(lambda s: _r(tq.relay_types(s), "leaf_percent", "single_percent", "variable_percent")),
        "volume": _q(lambda s: _r(tq.volume(s, analysis.span_bytes()), "window_s", "tib_a_day", "dollars_a_month", digits=9)),
        "failure_sections": _scored(lambda s, h: _r(failure_sections(s, h), "skew", "avg_depth", "shared_edge_rate", "fidelity", "their_fidelity", "delta", "meta_ratio")),
        "offset_percentiles": offset_percentiles,
        "paths_of_five": lambda spark, sf_dir: tree.paths(normalise.derived(conversations_as_spans(spark, sf_dir), DAY_US)).select("span_id", F.translate(F.array_join("path", ">"), "\0", ";").alias("path")),
        "step_timings": _q(step_timings),
        "measured_costs": _q(measured),
        "scalability": _q(scalability),
        "shapley_importance": _scored(shapley_importance),
        "mode_normalised": _k(mode_normalised),
    }
