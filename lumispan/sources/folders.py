"""Folders of span files: formats side by side, runs of scenarios, packed model files, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import JAEGER, OTLP, detect_format, jaeger_spans, otlp_spans, read_otlp_proto, read_spans, read_trace_csv

RUNS = ("1", "2", "3")


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The names of what a folder holds, or the path itself; through Hadoop's file systems, so any store will do."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_json_folder(spark: SparkSession, files: list[str]) -> DataFrame:
    """The spans of JSON files of both formats side by side. Each reader takes all files and keeps what has its own keys, so
    nobody has to look into a file first: OTLP is a request a line, or a request a file where no line of it is one; Jaeger is
    a document a file."""
    lines = spark.read.schema(OTLP).option("mode", "DROPMALFORMED").json(files)
    lines = lines.where("resourceSpans is not null").select("resourceSpans", F.col("_metadata.file_path").alias("file"))
    whole = spark.read.schema(f"{OTLP}, {JAEGER}").option("multiLine", True).json(files).select("resourceSpans", "data", F.col("_metadata.file_path").alias("file"))
    single = whole.where("resourceSpans is not null").join(lines.select("file").distinct(), "file", "left_anti")
    otlp = otlp_spans(lines.select("resourceSpans").unionByName(single.select("resourceSpans")))
    return otlp.unionByName(jaeger_spans(whole.where("data is not null").select("data")))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """The spans of all *.json, *.jsonl, *.pb and *.csv files of a folder."""
    names = files_of(spark, path)
    parts = []
    json = [n for n in names if n.endswith(".json") or n.endswith(".jsonl")]
    if json:
        parts.append(read_json_folder(spark, json))
    if any(n.endswith(".pb") for n in names):
        parts.append(read_otlp_proto(spark, f"{path}/*.pb"))
    if any(n.endswith(".csv") for n in names):
        parts.append(read_trace_csv(spark, f"{path}/*.csv"))
    if not parts:
        raise ValueError(f"no span files in {path}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_lenient_csv(spark: SparkSession, path) -> DataFrame:
    """What counting needs of trace CSV files: file, trace_id, span_id, service, operation, start_us, dur_us. Any column may be
    missing and bad rows are skipped."""
    raw = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("escape", '"').csv(path)
    text = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    number = lambda c: F.expr(f"try_cast({c} as bigint)") if c in raw.columns else F.lit(None).cast("bigint")
    rows = raw.select(
        F.col("_metadata.file_path").alias("file"), text("traceID").alias("trace_id"), text("spanID").alias("span_id"),
        text("serviceName").alias("service"), text("operationName").alias("operation"), number("startTime").alias("start_us"), number("duration").alias("dur_us"),
    )
    return rows.where("coalesce(trace_id, '') <> '' AND coalesce(span_id, '') <> ''")


def scenario_runs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of <scenario>/<run>/traces.csv under a folder, with scenario and run."""
    found = f"{path}/*/{{{','.join(RUNS)}}}/traces.csv"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p):
        raise ValueError(f"no <scenario>/<run>/traces.csv under {path}")
    part = lambda i: F.regexp_extract("file", r"([^/]+)/([^/]+)/traces\.csv", i)
    return read_lenient_csv(spark, found).withColumn("scenario", part(1)).withColumn("run", part(2)).drop("file")


def kind_of(spark: SparkSession, path: str) -> str:
    """What a path holds: 'runs' (a folder of folders, one a scenario), 'folder' (of span files) or the format of a file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.getFileStatus(p).isDirectory():
        return detect_format(spark, path)
    return "runs" if any(s.isDirectory() for s in fs.listStatus(p)) else "folder"


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """The spans of a file, a folder of files, or a folder of scenarios, whose rows have scenario and run as well."""
    kind = kind_of(spark, path)
    return {"runs": scenario_runs, "folder": read_folder}.get(kind, read_spans)(spark, path)


def run_averages(runs: DataFrame) -> DataFrame:
    """One row: runs, and per run the mean of spans, traces and seconds, whole numbers down; the services of all of them."""
    per = runs.groupBy("scenario", "run").agg(
        F.count(F.lit(1)).alias("spans"), F.countDistinct("trace_id").alias("traces"), F.min("start_us").alias("lo"), F.max(F.col("start_us") + F.coalesce("dur_us", F.lit(0))).alias("hi")
    )
    services = runs.where("coalesce(service, '') <> ''").agg(F.countDistinct("service").alias("services"))
    one = per.agg(
        F.count(F.lit(1)).alias("runs"), F.floor(F.avg("spans")).alias("spans"), F.floor(F.avg("traces")).alias("traces"),
        F.avg(F.greatest(F.lit(0), F.col("hi") - F.col("lo")) / 1e6).alias("window_s"),
    )
    return one.crossJoin(F.broadcast(services))  # a row on either side


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Gzip files of JSON lines: file, bytes, raw_bytes, lines. A file is unpacked a megabyte at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        def measured(data: bytes) -> tuple[int, int]:
            raw = lines = 0
            while data:  # a file may be several members
                unpack = zlib.decompressobj(31)
                while data and not unpack.eof:
                    part = unpack.decompress(data, 1 << 20)
                    raw, lines, data = raw + len(part), lines + part.count(b"\n"), unpack.unconsumed_tail
                data = unpack.unused_data
            return raw, lines

        for b in batches:
            found = [measured(c) for c in b["content"]]
            yield pd.DataFrame({"file": b["path"], "bytes": b["length"], "raw_bytes": [f[0] for f in found], "lines": [f[1] for f in found]})

    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    return files.mapInPandas(run, "file string, bytes bigint, raw_bytes bigint, lines bigint")


REPORT = "report_type string, approach string, group_key string, metric string, value double"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Long report rows, as ``write_report`` leaves them."""
    kinds = ", ".join(x for x in REPORT.split(", ") if not x.startswith("report_type"))
    return spark.read.schema(f"{kinds}, report_type string").json(path).select(*[x.split()[0] for x in REPORT.split(", ")])


def nested_report(spark: SparkSession, path: str) -> DataFrame:
    """Long rows of a report kept as one object: reports -> type -> approach -> group -> metric -> number."""
    shape = "reports map<string,map<string,map<string,map<string,double>>>>"
    r = spark.read.schema(shape).option("multiLine", True).json(path)
    for name, of in (("report_type", "reports"), ("approach", "v1"), ("group_key", "v2"), ("metric", "v3")):
        before = [c for c in r.columns if c != of]
        r = r.select(*before, F.explode(of).alias(name, {"reports": "v1", "v1": "v2", "v2": "v3", "v3": "value"}[of]))
    return r.select(*[x.split()[0] for x in REPORT.split(", ")])


def merged_reports(*reports: DataFrame) -> DataFrame:
    """Rows of all reports; of equal places the last report's stays."""
    key = ["report_type", "approach", "group_key", "metric"]
    out = reports[0].withColumn("_i", F.lit(0))
    for i, r in enumerate(reports[1:], 1):
        out = out.unionByName(r.withColumn("_i", F.lit(i)))
    return out.groupBy(*key).agg(F.max_by("value", "_i").alias("value"))


def jaeger_documents(spans: DataFrame) -> DataFrame:
    """A Jaeger JSON document per trace: trace_id, value."""
    tags = F.transform(F.filter(F.map_entries("attrs"), lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: F.struct(e["key"].alias("key"), F.lit("string").alias("type"), e["value"].alias("value")))
    failed = F.when(F.col("status") == "2", F.array(F.struct(F.lit("error").alias("key"), F.lit("bool").alias("type"), F.lit("true").alias("value"))))
    kind = F.when(F.coalesce("kind", F.lit("")) != "", F.array(F.struct(F.lit("span.kind").alias("key"), F.lit("string").alias("type"), F.lower("kind").alias("value"))))
    none = F.array().cast("array<struct<key:string,type:string,value:string>>")
    up = F.when(F.coalesce("parent_span_id", F.lit("")) != "", F.array(F.struct(F.lit("CHILD_OF").alias("refType"), F.col("parent_span_id").alias("spanID"))))
    span = F.struct(
        F.col("trace_id").alias("traceID"), F.col("span_id").alias("spanID"), F.col("operation").alias("operationName"), F.col("start_us").alias("startTime"),
        F.col("dur_us").alias("duration"), F.col("service").alias("processID"), F.coalesce(up, F.array().cast("array<struct<refType:string,spanID:string>>")).alias("references"),
        F.concat(tags, F.coalesce(failed, none), F.coalesce(kind, none)).alias("tags"),
    )
    processes = F.map_from_entries(F.transform(F.array_sort(F.collect_set("service")), lambda s: F.struct(s, F.struct(s.alias("serviceName")))))
    t = spans.groupBy("trace_id").agg(F.collect_list(span).alias("spans"), processes.alias("processes"))
    return t.select("trace_id", F.to_json(F.struct(F.array(F.struct(F.col("trace_id").alias("traceID"), "spans", "processes")).alias("data"))).alias("value"))


def csv_rows(spans: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """Spans as rows of a trace CSV."""
    code = F.when(F.col("status") == "2", "2.0").when(F.col("status") == "1", "1.0").otherwise("0.0")
    return spans.select(
        F.col("trace_id").alias("traceID"), F.col("span_id").alias("spanID"), F.col("service").alias("serviceName"), F.col("operation").alias("operationName"),
        F.col("start_us").alias("startTime"), F.col("dur_us").alias("duration"), code.alias("statusCode"), F.col("parent_span_id").alias("parentSpanID"),
        *[F.col("attrs")[a].alias(a) for a in attributes],
    )
