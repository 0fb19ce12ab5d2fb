"""Streams of spans: buffering by trace, windowed rates, training per batch, regeneration, running detection.

Spans carry ``ts`` (timestamp of their start) beside the span columns. What arrives later than the watermark is
dropped; a batch reader would have kept it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.diagnosis import ALARM, BASELINE_POINTS, SLACK
from ..operators.generate import generate
from ..operators.model import Model, train
from ..operators.normalise import derived, last_wins
from ..operators.samplers import PathModel, keep_probability
from ..schema import ModelConfig
from ..sources.feed import ModelFeed

SPAN_COLUMNS = ["trace_id", "span_id", "parent_span_id", "service", "operation", "kind", "status", "start_us", "dur_us"]


@dataclass(frozen=True)
class BufferConfig:
    flush_seconds: int = 120
    max_files_per_flush: int = 200
    max_traces_per_model: int = 100_000
    watermark: str = "2 minutes"

    def __post_init__(self) -> None:
        if min(self.flush_seconds, self.max_files_per_flush, self.max_traces_per_model) <= 0:
            raise ValueError("flush_seconds, max_files_per_flush and max_traces_per_model must be positive")


def span_stream(spark: SparkSession, path: str, config: BufferConfig = BufferConfig()) -> DataFrame:
    """Parquet files of spans as they appear; as many files per batch as the configuration allows."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.max_files_per_flush).parquet(path)
    return raw.withColumn("ts", F.timestamp_micros("start_us"))


def once(stream: DataFrame, watermark: str = "2 minutes") -> DataFrame:
    """Each (trace, span id) once: the first that arrives."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["trace_id", "span_id"])


def rates(stream: DataFrame, width: str = "60 seconds") -> DataFrame:
    """Spans and errors per window and service of a stream that has a watermark, such as ``once`` returns."""
    w = stream.groupBy(F.window("ts", width), "service")
    out = w.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("status") == "2").cast("bigint")).alias("errors"))
    return out.select(F.col("window.start").alias("start"), "service", "n", "errors")


def assembled(stream: DataFrame, quiet: str = "2 minutes", quiet_ms: int = 120_000) -> DataFrame:
    """Spans of whole traces: a trace is held until it has been quiet in event time, later spans of an id win."""
    columns = SPAN_COLUMNS

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            rows = list(json.loads(state.get[0]).values())
            state.remove()
            yield pd.DataFrame(rows, columns=columns)
            return
        held = json.loads(state.get[0]) if state.exists else {}
        latest = 0
        for b in batches:
            for r in b[columns].astype(object).where(b[columns].notna(), None).to_numpy().tolist():
                held[r[1]] = r
                latest = max(latest, int(r[7]) // 1000)
        state.update((json.dumps(held),))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + quiet_ms)
        yield pd.DataFrame([], columns=columns)

    out = "trace_id string, span_id string, parent_span_id string, service string, operation string, kind string, status string, start_us bigint, dur_us bigint"
    grouped = stream.withWatermark("ts", quiet).select(*columns, "ts").groupBy("trace_id")
    return grouped.applyInPandasWithState(step, out, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def train_batches(stream: DataFrame, models: str, checkpoint: str, config: ModelConfig, order: str = "ts", buffer: BufferConfig = BufferConfig()):
    """Train on each batch and save its model under ``models``/<batch>; a retried batch overwrites itself. A batch of more traces
    than the buffer holds becomes several models, of the traces dealt by hash. Drains what is there and stops, as a collector
    does when it shuts down."""

    def flush(batch: DataFrame, number: int) -> None:
        spans = last_wins(batch, order).drop("ts")
        parts = -(-spans.select("trace_id").distinct().count() // buffer.max_traces_per_model)
        for i in range(parts):
            part = spans.where(F.pmod(F.xxhash64("trace_id"), F.lit(parts)) == i) if parts > 1 else spans
            name = f"batch={number}" if parts == 1 else f"batch={number}-{i}"
            train(derived(part, config.bucket_us, config.primary), config).save(f"{models}/{name}")
            batch.sparkSession.range(1).write.mode("overwrite").parquet(f"{models}/{name}/done")  # last: the model is whole

    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def regenerate_batches(spark: SparkSession, models: str, checkpoint: str, config: ModelConfig, emit: Callable[[DataFrame, str], None]):
    """Watch for start tables of new models and hand each model's synthetic spans to ``emit``."""
    schema = "bucket bigint, trace_type string, feature string, child_count bigint, n bigint"
    found = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{models}/*/start")
    named = found.select(F.regexp_extract(F.input_file_name(), r"(batch=[\d-]+)", 1).alias("name"))

    def flush(batch: DataFrame, number: int) -> None:
        for row in batch.distinct().collect():  # names of the models that this trigger found
            emit(generate(Model.load(spark, f"{models}/{row['name']}", config)), row["name"])

    return named.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def regenerate_feed(spark: SparkSession, models: str, checkpoint: str, config: ModelConfig, emit: Callable[[DataFrame, str], None], queue: int = 16):
    """Hand the synthetic spans of each finished model to ``emit``, in order; of more than ``queue`` models that finished
    meanwhile the oldest are dropped. Drains what is there and stops."""
    spark.dataSource.register(ModelFeed)
    found = spark.readStream.format("model_feed").option("path", models).option("queue", queue).load()

    def flush(batch: DataFrame, number: int) -> None:
        for row in batch.orderBy("name").collect():  # at most ``queue`` names
            emit(generate(Model.load(spark, row["path"], config)), row["name"])

    return found.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_cusum(series: DataFrame) -> DataFrame:
    """Cumulative sums of a stream of (service, signal, time, value), by the rule of the batch operator, where times
    come in order: the first points are the baseline, sums run over those after them."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base, up, down = json.loads(state.get[0]) if state.exists else ([], 0.0, 0.0)
        rows = []
        points = pd.concat(list(batches)).sort_values("time")
        for time, value in zip(points["time"], points["value"], strict=True):
            if len(base) < BASELINE_POINTS:
                base.append(float(value))
                continue
            s = pd.Series(base)
            if not s.std() > 0:
                continue
            z = (value - s.mean()) / s.std()
            up, down = max(0.0, up + z - SLACK), min(0.0, down + z + SLACK)
            alarm = max(up, -down) > ALARM
            rows.append((*key, int(time), max(up, -down), alarm))
            if alarm:
                up = down = 0.0
        state.update((json.dumps([base, up, down]),))
        yield pd.DataFrame(rows, columns=["service", "signal", "time", "size", "alarm"])

    out = "service string, signal string, time bigint, size double, alarm boolean"
    return series.groupBy("service", "signal").applyInPandasWithState(step, out, "held string", "append", GroupStateTimeout.NoTimeout)


def running_sifter(traces: DataFrame, vocabulary: int, rate: int, window: int = 50, seed: int = 42) -> DataFrame:
    """Learned sampling of a stream of traces (stream, trace_id, start_us, paths: feature numbers of its paths of five, draw in
    [0, 1)): per stream one model that learns on, and what it keeps. Traces of a batch are taken in order of their start."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model = PathModel(vocabulary, seed=seed)
        recent: list[float] = []
        if state.exists:
            held = json.loads(state.get[0])
            recent = held["recent"]
            model.inner, model.outer = np.array(held["inner"]), np.array(held["outer"])
        rows = []
        for r in pd.concat(list(batches)).sort_values(["start_us", "trace_id"]).itertuples(index=False):
            each = [model.learn([int(x) for x in p]) for p in r.paths]
            loss = float(np.mean(each)) if each else 0.0
            rows.append((r.trace_id, loss, bool(r.draw < keep_probability(recent, loss, rate, window))))
            recent = [*recent, loss][-window:]
        state.update((json.dumps({"recent": recent, "inner": model.inner.tolist(), "outer": model.outer.tolist()}),))
        yield pd.DataFrame(rows, columns=["trace_id", "loss", "kept"])

    out = "trace_id string, loss double, kept boolean"
    return traces.groupBy("stream").applyInPandasWithState(step, out, "held string", "append", GroupStateTimeout.NoTimeout)
