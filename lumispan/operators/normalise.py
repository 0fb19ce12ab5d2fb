"""From raw spans to the spans that queries read: duplicates, derived columns, pruning, repair, remapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expressions import hash32, signature
from ..schema import MINUTE_US, PRIMARY
from .numbering import numbered
from .tree import closure, with_parent


def last_wins(spans: DataFrame, order: str) -> DataFrame:
    """One span per (trace, span id): the one of the highest ``order``."""
    w = W.partitionBy("trace_id", "span_id").orderBy(F.desc(order))
    return spans.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def derived(spans: DataFrame, bucket_us: int = MINUTE_US, primary: tuple[str, ...] = PRIMARY) -> DataFrame:
    """Add has_parent, is_root, minute, trace_start, bucket, feature, is_error, error_trace.

    One shuffle by trace serves the parent test and the trace windows; the parent test is a join on the
    trace's own spans, so a trace of any size is spread by its span ids only if Spark splits it.
    """
    trace = W.partitionBy("trace_id")
    s = with_parent(spans, [])
    return s.select(
        *spans.columns,
        F.col("p_span_id").isNotNull().alias("has_parent"),
        F.col("p_span_id").isNull().alias("is_root"),
        F.expr(f"start_us DIV {MINUTE_US}").alias("minute"),
        F.min("start_us").over(trace).alias("trace_start"),
        F.floor(F.min("start_us").over(trace) / bucket_us).cast("bigint").alias("bucket"),
        signature({c: F.col(c) for c in primary}).alias("feature"),
        (F.col("status") == "2").alias("is_error"),
        (F.max(F.col("status") == "2").over(trace) if "status" in primary else F.lit(False)).alias("error_trace"),
    )


def pruned(spans: DataFrame, keep: list[str]) -> DataFrame:
    """Keep the named attributes only."""
    return spans.withColumn("attrs", F.map_filter("attrs", lambda k, v: k.isin(*keep) if keep else F.lit(False)))


def envelope_repaired(spans: DataFrame) -> DataFrame:
    """Every span starts no later and ends no earlier than all spans below it."""
    pairs = closure(spans)
    below = spans.select("trace_id", "span_id", "start_us", (F.col("start_us") + F.col("dur_us")).alias("end_us"))
    reach = (
        pairs.join(below, ["trace_id", "span_id"])
        .groupBy("trace_id", F.col("ancestor").alias("span_id"))
        .agg(F.min("start_us").alias("_lo"), F.max("end_us").alias("_hi"))
    )
    lo = F.least("start_us", F.coalesce("_lo", "start_us"))
    hi = F.greatest(F.col("start_us") + F.col("dur_us"), F.coalesce("_hi", F.col("start_us")))
    return (
        spans.join(reach, ["trace_id", "span_id"], "left")
        .withColumn("_s", lo)
        .withColumn("_e", hi)
        .withColumn("start_us", F.col("_s"))
        .withColumn("dur_us", F.col("_e") - F.col("_s"))
        .select(*spans.columns)
    )


def remapped(spans: DataFrame, width_us: int = MINUTE_US, seed: int = 42) -> DataFrame:
    """Shift every trace to a uniform start in [0, width - length]; traces longer than the width leave."""
    trace = W.partitionBy("trace_id")
    lo = F.min("start_us").over(trace)
    length = F.max(F.col("start_us") + F.col("dur_us")).over(trace) - lo
    s = spans.withColumn("_lo", lo).withColumn("_len", length).where(F.col("_len") <= width_us)
    room = F.lit(width_us) - F.col("_len")
    shift = F.pmod(hash32("remap", F.lit(seed), F.col("trace_id")), room + 1)
    return s.withColumn("start_us", F.col("start_us") - F.col("_lo") + shift).select(*spans.columns)


def subsampled(spans: DataFrame, traces: int, seed: int = 42) -> DataFrame:
    """The spans of ``traces`` traces, chosen by hash: a limit because it is asked for."""
    ids = spans.select("trace_id").distinct()
    chosen = ids.orderBy(F.md5(F.concat_ws(":", "trace_id", F.lit(seed))), "trace_id").limit(traces)
    return spans.join(chosen, "trace_id", "left_semi")


def trace_chunks(spans: DataFrame, traces: int = 500) -> DataFrame:
    """Add chunk: whole traces in order of their ids, so many a chunk and the rest in the last."""
    ids = numbered(spans.select("trace_id").distinct(), ["trace_id"], "_i")
    return spans.join(ids.select("trace_id", F.floor(F.col("_i") / traces).cast("bigint").alias("chunk")), "trace_id")


def chunks(spans: DataFrame, max_spans: int) -> DataFrame:
    """Add chunk: traces of a bucket dealt by hash over ceil(spans / max_spans) chunks, never split."""
    sizes = spans.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / max_spans).alias("_subs"))
    return spans.join(sizes, "bucket").withColumn("chunk", F.pmod(hash32(F.col("trace_id")), F.col("_subs")).cast("int")).drop("_subs")
