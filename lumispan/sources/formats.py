"""Span file formats: OTLP JSON and protobuf, Jaeger JSON, trace CSV, flat CSV; which one a path holds; writers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import padded_hex, status_text
from ..plans.storage import stored
from ..schema import SPAN

_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
_SPAN = (
    "struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,"
    f"endTimeUnixNano:string,status:struct<code:string>,attributes:{_ATTRIBUTES}>"
)
OTLP = f"resourceSpans array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:array<struct<spans:array<{_SPAN}>>>>>"
JAEGER = (
    "data array<struct<traceID:string,spans:array<struct<traceID:string,spanID:string,operationName:string,startTime:bigint,duration:bigint,"
    "processID:string,references:array<struct<refType:string,spanID:string>>,tags:array<struct<key:string,type:string,value:string>>>>,"
    "processes:map<string,struct<serviceName:string>>>>"
)
# Names of kinds and statuses in the wire format's JSON.
KIND_NAMES = ("SPAN_KIND_UNSPECIFIED", "SPAN_KIND_INTERNAL", "SPAN_KIND_SERVER", "SPAN_KIND_CLIENT", "SPAN_KIND_PRODUCER", "SPAN_KIND_CONSUMER")
STATUS_NAMES = ("STATUS_CODE_UNSET", "STATUS_CODE_OK", "STATUS_CODE_ERROR")
CSV_COLUMNS = ("traceID", "spanID", "serviceName", "operationName", "startTime", "duration", "statusCode", "parentSpanID")


def _number(c: Column, names: tuple[str, ...]) -> Column:
    chain = F.when(c.isNull(), 0)
    for i, n in enumerate(names):
        chain = chain.when(c == n, i)
    return chain.otherwise(F.try_to_number(c, F.lit("9")).cast("int"))


def _as_map(attributes: Column) -> Column:
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    entries = F.transform(F.coalesce(attributes, F.array().cast(_ATTRIBUTES)), lambda a: F.struct(a["key"], text(a["value"])))
    return F.map_from_entries(F.filter(entries, lambda e: e["key"].isNotNull()))


def otlp_spans(requests: DataFrame) -> DataFrame:
    """Spans of rows of the OTLP export request; of equal (trace, span id) pairs callers keep one."""
    from ..functions.expressions import kind_name

    r = requests.select(F.explode("resourceSpans").alias("r"))
    r = r.select(_as_map(F.col("r.resource.attributes")).alias("res"), F.explode("r.scopeSpans").alias("c"))
    s = r.select("res", F.explode("c.spans").alias("s")).withColumn("attrs", _as_map(F.col("s.attributes")))
    start = F.floor(F.col("s.startTimeUnixNano").cast("decimal(20,0)") / 1000).cast("bigint")
    length = F.floor((F.col("s.endTimeUnixNano").cast("decimal(20,0)") - F.col("s.startTimeUnixNano").cast("decimal(20,0)")) / 1000).cast("bigint")
    kind = kind_name(_number(F.col("s.kind"), KIND_NAMES))
    return s.select(
        padded_hex(F.col("s.traceId"), 32).alias("trace_id"), padded_hex(F.col("s.spanId"), 16).alias("span_id"),
        F.when(F.coalesce("s.parentSpanId", F.lit("")) != "", padded_hex(F.col("s.parentSpanId"), 16)).alias("parent_span_id"),
        F.coalesce(F.col("res")["service.name"], F.lit("unknown")).alias("service"), F.col("s.name").alias("operation"),
        F.when(kind == "", F.coalesce(F.col("attrs")["span.kind"], F.lit(""))).otherwise(kind).alias("kind"),
        status_text(_number(F.col("s.status.code"), STATUS_NAMES)).alias("status"), start.alias("start_us"),
        F.greatest(F.lit(0).cast("bigint"), length).alias("dur_us"), "attrs",
    )


def read_otlp_json(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """OTLP JSON, a request per line (malformed lines are skipped) or per file."""
    return otlp_spans(spark.read.schema(OTLP).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path))


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        i += 1
        if b[i - 1] < 128:
            return out, i
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        wire = tag & 7
        if wire == 0:
            v, i = _varint(b, i)
        elif wire == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            n = 8 if wire == 1 else 4
            v, i = int.from_bytes(b[i : i + n], "little"), i + n
        yield tag >> 3, v


def _attributes(pairs: list[bytes]) -> dict[str, str]:
    import struct

    out = {}
    for p in pairs:
        f = dict(_fields(p))
        for k, v in _fields(f.get(2, b"")):
            if k == 1:
                out[f[1].decode()] = v.decode("utf-8", "replace")
            elif k == 2:
                out[f[1].decode()] = "true" if v else "false"
            elif k == 3:
                out[f[1].decode()] = str(v - (1 << 64) if v >> 63 else v)
            elif k == 4:
                out[f[1].decode()] = repr(struct.unpack("<d", v.to_bytes(8, "little"))[0])
    return out


#: Bytes of a protobuf file that Python is handed at a time, and spans that it hands back.
BLOCK, ROWS = 1 << 22, 5_000


def _whole_fields(b: bytearray) -> tuple[list[tuple[int, int | bytes]], int]:
    """The fields at the start of ``b`` that are whole, and where the first one that isn't begins."""
    out, i = [], 0
    while i < len(b):
        try:
            tag, at = _varint(b, i)
            wire = tag & 7
            if wire == 0:
                v, at = _varint(b, at)
            else:
                n, at = _varint(b, at) if wire == 2 else (8 if wire == 1 else 4, at)
                if at + n > len(b):
                    break
                v, at = bytes(b[at : at + n]), at + n
                v = v if wire == 2 else int.from_bytes(v, "little")
        except IndexError:
            break
        out.append((tag >> 3, v))
        i = at
    return out, i


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int | bytes]]:
    """The fields of files that come as blocks in order; of a file no more is held than a block and the field it ends in."""
    held = bytearray()
    for batch in batches:
        for at, block in zip(batch["at"], batch["block"], strict=True):
            if at == 1:
                yield from _fields(bytes(held))  # what a broken file ended with
                held = bytearray()
            held += block
            whole, used = _whole_fields(held)
            yield from whole
            del held[:used]
    yield from _fields(bytes(held))


def read_otlp_proto(spark: SparkSession, path: str) -> DataFrame:
    """OTLP protobuf files, one request each, stored as rows: Python gets a file in blocks and gives spans back in batches, so
    what it holds doesn't grow with the files."""
    from ..functions.expressions import KINDS

    def rows_of(resource: bytes) -> Iterator[tuple]:
        parts = list(_fields(resource))
        held = _attributes([v for k, r in parts if k == 1 for kk, v in _fields(r) if kk == 1])
        for scope in (v for k, v in parts if k == 2):
            for span in (v for k, v in _fields(scope) if k == 2):
                f: dict = {}
                pairs = []
                for k, v in _fields(span):
                    if k == 9:
                        pairs.append(v)
                    else:
                        f[k] = v
                kind = int(f.get(6, 0))
                code = dict(_fields(f.get(15, b""))).get(3, 0)
                start, end = int(f.get(7, 0)), int(f.get(8, 0))
                yield (
                    f.get(1, b"").hex(), f.get(2, b"").hex(), f[4].hex() if f.get(4) else None, held.get("service.name", "unknown"),
                    f.get(5, b"").decode("utf-8", "replace"), KINDS[kind] if kind < len(KINDS) else "", str(code) if code in (0, 1, 2) else "0",
                    start // 1000, max(0, (end - start) // 1000), _attributes(pairs),
                )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in SPAN.fields]
        rows = (r for n, resource in _streamed(batches) if n == 1 for r in rows_of(resource))
        while some := list(islice(rows, ROWS)):
            yield pd.DataFrame(some, columns=names)

    at = F.explode(F.sequence(F.lit(1), F.greatest(F.length("content"), F.lit(1)), F.lit(BLOCK))).alias("at")
    blocks = spark.read.format("binaryFile").load(path).select("content", at)
    blocks = blocks.select("at", F.substring(F.col("content"), F.col("at"), F.lit(BLOCK)).alias("block"))
    return stored(blocks.mapInPandas(run, SPAN), "otlp_proto", batch=1)


def read_jaeger(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Jaeger JSON, a document per file or per line: the parent is the first CHILD_OF reference; a tag error=true is the status, not an attribute."""
    return jaeger_spans(spark.read.schema(JAEGER).option("multiLine", not lines).json(path))


def jaeger_spans(documents: DataFrame) -> DataFrame:
    """Spans of rows of Jaeger documents."""
    t = documents.select(F.explode("data").alias("t"))
    s = t.select(F.col("t.processes").alias("p"), F.explode("t.spans").alias("s"))
    parent = F.get(F.filter(F.coalesce("s.references", F.array().cast("array<struct<refType:string,spanID:string>>")), lambda r: r["refType"] == "CHILD_OF"), 0)["spanID"]
    tags = F.coalesce("s.tags", F.array().cast("array<struct<key:string,type:string,value:string>>"))
    failed = F.exists(tags, lambda x: (x["key"] == "error") & (F.lower(x["value"]) == "true"))
    kept = F.filter(tags, lambda x: ~((x["key"] == "error") & (F.lower(x["value"]) == "true")) & F.coalesce(x["type"], F.lit("string")).isin("string", "bool", "float64", "int64"))
    attrs = F.map_from_entries(F.transform(kept, lambda x: F.struct(x["key"], x["value"])))
    return s.select(
        padded_hex(F.col("s.traceID"), 32).alias("trace_id"), padded_hex(F.col("s.spanID"), 16).alias("span_id"), padded_hex(parent, 16).alias("parent_span_id"),
        F.coalesce(F.col("p")[F.col("s.processID")]["serviceName"], F.lit("unknown")).alias("service"), F.col("s.operationName").alias("operation"),
        F.upper(F.coalesce(attrs["span.kind"], F.lit(""))).alias("kind"), F.when(failed, "2").otherwise("0").alias("status"),
        F.col("s.startTime").alias("start_us"), F.greatest(F.lit(0).cast("bigint"), F.col("s.duration")).alias("dur_us"), attrs.alias("attrs"),
    )


def read_trace_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV of spans with at least the columns of CSV_COLUMNS; rows without ids or with bad numbers are skipped, other
    columns become attributes."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    missing = [c for c in CSV_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    start, length = F.expr("try_cast(startTime as bigint)"), F.expr("try_cast(duration as bigint)")
    code = F.round(F.expr("try_cast(statusCode as double)")).cast("int")
    skip = {*CSV_COLUMNS, "time", "startTimeMillis"}
    names = [c for c in raw.columns if c not in skip]
    pairs = [F.struct(F.lit("method.name" if c == "methodName" else c), F.col(f"`{c}`").cast("string")) for c in names]
    attrs = F.map_filter(F.map_from_entries(F.array(*pairs)), lambda k, v: F.coalesce(v, F.lit("")) != "") if pairs else F.create_map().cast("map<string,string>")
    filled = (F.coalesce("traceID", F.lit("")) != "") & (F.coalesce("spanID", F.lit("")) != "")
    return raw.where(filled & start.isNotNull() & length.isNotNull()).select(
        padded_hex(F.col("traceID"), 32).alias("trace_id"), padded_hex(F.col("spanID"), 16).alias("span_id"),
        F.when(F.coalesce("parentSpanID", F.lit("")) != "", padded_hex(F.col("parentSpanID"), 16)).alias("parent_span_id"),
        F.coalesce(F.nullif(F.col("serviceName"), F.lit("")), F.lit("unknown")).alias("service"), F.coalesce("operationName", F.lit("")).alias("operation"), F.lit("").alias("kind"),
        F.when(code > 1, "2").when(code == 1, "1").otherwise("0").alias("status"), start.alias("start_us"), F.greatest(F.lit(0).cast("bigint"), length).alias("dur_us"), attrs.alias("attrs"),
    )


def read_flat_csv(spark: SparkSession, path: str, max_values: int = 50) -> tuple[DataFrame, list[str]]:
    """Flat spans with start_offset_us and is_root, and the extra columns that have more than ``max_values`` values."""
    from pyspark.sql import Window as W

    fixed = ("trace_id span_id parent_span_id service_name operation_name span_kind status_code start_time_us duration_us depth "
             "parent_service_name parent_operation_name num_siblings minute_bucket").split()  # fmt: skip
    raw = spark.read.option("header", True).csv(path)
    extras = [c for c in raw.columns if c not in fixed]
    raw = raw.na.fill("<NONE>", extras) if extras else raw
    counts = raw.agg(*[F.countDistinct(c).alias(c) for c in extras]).first() if extras else {}
    for c in ("start_time_us", "duration_us", "depth", "num_siblings", "minute_bucket"):
        raw = raw.withColumn(c, F.col(c).cast("bigint"))
    first = F.min("start_time_us").over(W.partitionBy("trace_id"))
    out = raw.withColumn("start_offset_us", F.col("start_time_us") - first).withColumn("is_root", F.coalesce("parent_span_id", F.lit("")) == "")
    return out, [c for c in extras if counts[c] > max_values]


def detect_format(spark: SparkSession, path: str) -> str:
    """csv, jaeger, otlp or proto, from the name or the keys of the first record."""
    if path.endswith(".csv"):
        return "csv"
    if path.endswith(".pb"):
        return "proto"
    keys = spark.read.schema(f"{OTLP}, {JAEGER}").option("multiLine", True).json(path).select((F.col("data").isNotNull()).alias("jaeger"))
    first = keys.limit(1).collect()
    return "jaeger" if first and first[0]["jaeger"] else "otlp"


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    kind = detect_format(spark, path)
    if kind == "otlp":
        return read_otlp_json(spark, path)
    return {"csv": read_trace_csv, "jaeger": read_jaeger, "proto": read_otlp_proto}[kind](spark, path)


def otlp_requests(spans: DataFrame) -> DataFrame:
    """A JSON request per trace, spans grouped by service in order of their names."""
    attribute = lambda k, v: F.struct(k.alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    attrs = F.transform(F.filter(F.map_entries("attrs"), lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: attribute(e["key"], e["value"]))
    code = F.array_position(F.array(F.lit(""), F.lit("INTERNAL"), F.lit("SERVER"), F.lit("CLIENT"), F.lit("PRODUCER"), F.lit("CONSUMER")), F.col("kind")) - 1
    nano = lambda c: F.concat(c.cast("string"), F.lit("000"))
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.coalesce("parent_span_id", F.lit("")).alias("parentSpanId"), F.col("operation").alias("name"),
        F.greatest(code, F.lit(0)).cast("int").alias("kind"), nano(F.col("start_us")).alias("startTimeUnixNano"), nano(F.col("start_us") + F.col("dur_us")).alias("endTimeUnixNano"),
        F.struct(F.col("status").cast("int").alias("code")).alias("status"), attrs.alias("attributes"),
    )
    service = spans.groupBy("trace_id", "service").agg(F.array_sort(F.collect_list(F.struct("start_us", "span_id", span.alias("s"))), _by_place).alias("x"))
    resource = F.struct(
        F.struct(F.array(attribute(F.lit("service.name"), F.col("service"))).alias("attributes")).alias("resource"),
        F.array(F.struct(F.transform("x", lambda x: x["s"]).alias("spans"))).alias("scopeSpans"),
    )
    grouped = service.select("trace_id", "service", F.to_json(resource).alias("r")).groupBy("trace_id")
    held = grouped.agg(F.array_sort(F.collect_list(F.struct("service", "r"))).alias("x"))
    return held.select("trace_id", F.concat(F.lit('{"resourceSpans":['), F.array_join(F.transform("x", lambda x: x["r"]), ","), F.lit("]}")).alias("value"))


def _by_place(a: Column, b: Column) -> Column:
    return (
        F.when(a["start_us"] < b["start_us"], -1).when(a["start_us"] > b["start_us"], 1)
        .when(a["span_id"] < b["span_id"], -1).when(a["span_id"] > b["span_id"], 1).otherwise(0)
    )


def write_otlp(spans: DataFrame, path: str, files: int | None = None) -> None:
    """JSON lines; a trace is never split over files."""
    requests = otlp_requests(spans)
    requests = requests.repartition(files, "trace_id") if files else requests
    requests.select("value").write.mode("overwrite").text(path)


def write_chunks(chunked: DataFrame, path: str) -> None:
    """Parquet by bucket and chunk, whole traces per chunk."""
    chunked.repartition("bucket", "chunk").write.mode("overwrite").partitionBy("bucket", "chunk").parquet(path)


def write_flat_csv(flat: DataFrame, path: str) -> None:
    flat.write.mode("overwrite").option("header", True).csv(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """Long report rows as JSON lines, partitioned by report type; an existing report is left alone."""
    report.write.mode("ignore").partitionBy("report_type").json(path)
