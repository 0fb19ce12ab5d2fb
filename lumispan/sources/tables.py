"""Spans from plain tables: user days of events, orders with their lines, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schema import DAY_US


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column) -> F.Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def events_as_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace per user and day; its events in time order form a binary heap, the first is the root."""
    e = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        micros("ts").alias("us"),
    )
    e = e.withColumn("day", F.expr(f"us DIV {DAY_US}"))
    trace = W.partitionBy("user_id", "day")
    e = e.withColumn("rn", F.row_number().over(trace.orderBy("us", "event_id"))).withColumn(
        "n", F.count(F.lit(1)).over(trace)
    )
    name = F.concat_ws("-", "user_id", "day")
    return e.select(
        name.alias("trace_id"),
        F.concat_ws("-", name, "rn").alias("span_id"),
        F.when(F.col("rn") > 1, F.concat_ws("-", name, F.expr("rn DIV 2"))).alias("parent_span_id"),
        F.col("event_type").alias("service"),
        F.concat(F.lit("k"), F.expr("k DIV 10")).alias("operation"),
        F.when(2 * F.col("rn") > F.col("n"), "CLIENT").otherwise("SERVER").alias("kind"),
        F.when(F.col("event_type") == "error", "2").otherwise("0").alias("status"),
        F.col("us").alias("start_us"),
        F.round(F.col("value") * 1000).cast("bigint").alias("dur_us"),
        F.create_map(F.lit("k"), F.col("k").cast("string")).alias("attrs"),
    )


def orders_as_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace per order; its lines, one second apart, are the root's children."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", micros("o_orderdate").alias("us")
    )
    every = [c for c in table(spark, sf_dir, "lineitem").columns]
    lines = table(spark, sf_dir, "lineitem").withColumn(
        "rn", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*every))
    )
    child = lines.join(o, lines.l_orderkey == o.o_orderkey).select(
        F.col("o_orderkey").cast("string").alias("trace_id"),
        F.concat_ws("-", "o_orderkey", "rn").alias("span_id"),
        F.concat_ws("-", "o_orderkey", F.lit(0)).alias("parent_span_id"),
        F.col("l_returnflag").alias("service"),
        F.col("l_linestatus").alias("operation"),
        F.lit("CLIENT").alias("kind"),
        F.lit("0").alias("status"),
        (F.col("us") + F.col("rn") * 1_000_000).alias("start_us"),
        (F.col("l_quantity") * 1000).cast("bigint").alias("dur_us"),
        F.create_map(F.lit("linenumber"), F.col("l_linenumber").cast("string")).alias("attrs"),
    )
    last = child.groupBy("trace_id").agg(F.max(F.col("start_us") + F.col("dur_us")).alias("_end"))
    root = o.join(last, o.o_orderkey.cast("string") == last.trace_id, "left").select(
        F.col("o_orderkey").cast("string").alias("trace_id"),
        F.concat_ws("-", "o_orderkey", F.lit(0)).alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        F.lit("orders").alias("service"),
        F.col("o_orderpriority").alias("operation"),
        F.lit("SERVER").alias("kind"),
        F.when(F.col("o_orderstatus") == "P", "2").otherwise("0").alias("status"),
        F.col("us").alias("start_us"),
        F.coalesce(F.col("_end") - F.col("us"), F.lit(1000)).cast("bigint").alias("dur_us"),
        F.create_map().cast("map<string,string>").alias("attrs"),
    )
    return root.unionByName(child)


def conversations_as_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace per conversation; each turn is the child of the one before."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("trace_id"),
        F.concat_ws("-", "conv_id", "turn").alias("span_id"),
        F.when(F.col("turn") > 0, F.concat_ws("-", "conv_id", F.col("turn") - 1)).alias("parent_span_id"),
        F.col("role").alias("service"),
        F.lit("turn").alias("operation"),
        F.lit("SERVER").alias("kind"),
        F.lit("0").alias("status"),
        (F.col("turn") * 1_000_000).cast("bigint").alias("start_us"),
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("dur_us"),
        F.create_map().cast("map<string,string>").alias("attrs"),
    )
