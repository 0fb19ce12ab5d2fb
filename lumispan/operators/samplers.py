"""What a generative model is compared with: head, tail and hindsight sampling, learned sampling, packed sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expressions import hash32


def head(spans: DataFrame, rate: int, seed: int = 42) -> DataFrame:
    """One trace in ``rate``, by hash of its id."""
    if rate <= 1:
        return spans
    return spans.where(hash32("head", F.lit(seed), F.col("trace_id")) < (1 << 32) // rate)


def value_at(counts: DataFrame, value: str, count: str, share: float) -> DataFrame:
    """One row: the value at position floor(share * n), from 0, of n values that are given with their counts.

    Values are cut at powers of 2^(1/64), some thousands of parts at most; running sums over the parts tell in which one the
    position lies, and only that part's values are put in order.
    """
    part = F.floor(F.log2(F.greatest(F.col(value), F.lit(0)).cast("double") + 1.0) * 64)
    c = counts.withColumn("_part", part)
    sums = c.groupBy("_part").agg(F.sum(count).alias("_s"))
    sums = sums.withColumn("_upto", F.sum("_s").over(W.orderBy("_part"))).withColumn("_at", F.floor(F.sum("_s").over(W.partitionBy(F.lit(1))) * share))
    here = sums.where(F.col("_upto") > F.col("_at")).agg(F.min(F.struct("_part", (F.col("_upto") - F.col("_s")).alias("_before"), "_at")).alias("_h"))
    here = here.select("_h.*")  # one row
    inside = c.join(F.broadcast(here), "_part").withColumn("_upto", F.col("_before") + F.sum(count).over(W.orderBy(value)))
    return inside.where(F.col("_upto") > F.col("_at")).agg(F.min(value).alias(value))


def classified(spans: DataFrame) -> DataFrame:
    """Per trace: root_dur (largest of spans without a parent id), error_trace, interesting (an error, or a root
    longer than the 95th of 100 such traces, by position)."""
    t = spans.groupBy("trace_id").agg(
        F.max((F.col("status") == "2")).alias("error_trace"),
        F.coalesce(F.max(F.when(F.coalesce("parent_span_id", F.lit("")) == "", F.col("dur_us"))), F.lit(0)).alias("root_dur"),
    )
    limit = value_at(t.groupBy("root_dur").agg(F.count(F.lit(1)).alias("c")), "root_dur", "c", 0.95).withColumnRenamed("root_dur", "_p95")
    return t.crossJoin(F.broadcast(limit)).select(
        "trace_id", "root_dur", "error_trace", (F.col("error_trace") | (F.col("root_dur") > F.col("_p95"))).alias("interesting")
    )


def tail(spans: DataFrame) -> DataFrame:
    """The spans of interesting traces. Its cost is that of all spans; hindsight's, of what it returns."""
    return spans.join(classified(spans).where("interesting").select("trace_id"), "trace_id", "left_semi")


hindsight = tail


class PathModel:
    """Predicts the middle of a path of five: the four other embeddings side by side, a layer, a softmax over the vocabulary."""

    def __init__(self, vocabulary: int, width: int = 10, rate: float = 0.01, seed: int = 42) -> None:
        r = np.random.default_rng(seed)
        self.inner = r.normal(0.0, np.sqrt(2.0 / (vocabulary + width)), (vocabulary, width))
        self.outer = r.normal(0.0, np.sqrt(2.0 / (4 * width + vocabulary)), (vocabulary, 4 * width))
        self.rate = rate

    def learn(self, path: list[int]) -> float:
        """The loss of a path before the step that it causes."""
        context, target = [*path[:2], *path[3:]], path[2]
        h = self.inner[context].ravel()
        z = self.outer @ h
        p = np.exp(z - z.max())
        p /= p.sum()
        loss = -np.log(max(p[target], 1e-30))
        p[target] -= 1.0
        back = p @ self.outer
        self.outer -= self.rate * np.outer(p, h)
        np.subtract.at(self.inner, context, self.rate * back.reshape(4, -1))
        return float(loss)


def keep_probability(recent: list[float], loss: float, rate: int, window: int) -> float:
    """1 until ``window`` traces were seen; then by the loss above the least of the last ``window`` ones."""
    if len(recent) < window:
        return 1.0
    least = min(recent)
    over = loss - least
    total = sum(x - least for x in recent) + over
    p = 1.0 / rate if total < 1e-30 else over / total * (window + 1) / rate
    return min(1.0, max(0.0, p))


def walked_paths(ids: list[str], ups: list[str], numbers: list[int], length: int = 5) -> list[list[int]]:
    """The paths that end at each span of a trace, depth first; spans come in order of their start."""
    at = {x: i for i, x in enumerate(ids)}
    below: dict[int, list[int]] = {}
    roots = []
    for i in at.values():
        up = at.get(ups[i])
        (roots if up is None else below.setdefault(up, [])).append(i)
    out, todo = [], [(i, ()) for i in reversed(roots)]
    while todo:
        i, above = todo.pop()
        chain = (*above, int(numbers[i]))[-length:]
        if len(chain) == length:
            out.append(list(chain))
        todo += [(j, chain) for j in reversed(below.get(i, []))]
    return out


def sifter(spans: DataFrame, rate: int, window: int = 50, seed: int = 42, shards: int = 1) -> DataFrame:
    """Spans of traces kept with a probability that follows how badly their paths were predicted.

    Traces are learned in order of their start, which is a fold over everything: one model, one window of losses, one
    task. With more ``shards`` the traces are dealt by hash over independent streams, as parallel collectors would,
    each with its own model and its own warm-up of ``window`` kept traces. The vocabulary is fitted on all spans.
    """
    vocabulary = spans.select("feature").distinct()
    size = vocabulary.count()
    numbers = vocabulary.withColumn("number", F.row_number().over(W.orderBy("feature")) - 1)
    nodes = spans.select("trace_id", "span_id", "parent_span_id", "start_us", "feature").join(numbers, "feature")
    traces = nodes.groupBy("trace_id").agg(
        F.min("start_us").alias("start_us"), F.array_sort(F.collect_list(F.struct("start_us", "span_id", "parent_span_id", "number"))).alias("s")
    )
    traces = traces.select("trace_id", "start_us", *[F.col(f"s.{c}").alias(c) for c in ("span_id", "parent_span_id", "number")])
    traces = traces.withColumn("shard", F.pmod(hash32("shard", F.col("trace_id")), F.lit(shards)))
    draw = (hash32("sifter", F.lit(seed), F.col("trace_id")) + 0.5) / float(1 << 32)
    traces = traces.withColumn("draw", draw).repartition("shard").sortWithinPartitions("shard", "start_us", "trace_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, model, recent = None, None, []
        for batch in batches:
            keep, losses = [], []
            for shard, ids, ups, found, u in zip(*(batch[c] for c in ("shard", "span_id", "parent_span_id", "number", "draw")), strict=True):
                if shard != now:
                    now, model, recent = shard, PathModel(max(size, 1), seed=seed), []
                each = [model.learn(p) for p in walked_paths(ids, ups, found)]
                loss = float(np.mean(each)) if each else 0.0
                keep.append(bool(u < keep_probability(recent, loss, rate, window)))
                recent = [*recent, loss][-window:]
                losses.append(loss)
            yield pd.DataFrame({"trace_id": batch["trace_id"], "loss": losses, "kept": keep})

    return traces.mapInPandas(run, "trace_id string, loss double, kept boolean")


def gzip_bytes(spans: DataFrame) -> DataFrame:
    """Spans as JSON lines: rows, bytes and gzip bytes, packed per partition."""
    from .model import _packed_size

    packed = spans.select(F.to_json(F.struct("*")).alias("j")).mapInPandas(_packed_size, "rows bigint, raw bigint, gz bigint")
    return packed.agg(F.sum("rows").alias("rows"), F.sum("raw").alias("raw_bytes"), F.sum("gz").alias("gz_bytes"))


def arrow_bytes(spans: DataFrame, batch: int = 5000) -> DataFrame:
    """Spans as Arrow record batches with fresh dictionaries: rows and zstd bytes."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                columns = [c.dictionary_encode() if pa.types.is_string(c.type) else c for c in part.columns]
                sink = pa.BufferOutputStream()
                t = pa.RecordBatch.from_arrays(columns, names=part.schema.names)
                with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(t)
                yield pa.RecordBatch.from_pydict({"rows": [part.num_rows], "bytes": [sink.getvalue().size]})

    plain = spans.select(*[c for c, k in spans.dtypes if not k.startswith("map")])
    return plain.mapInArrow(run, "rows bigint, bytes bigint").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("arrow_bytes"))
