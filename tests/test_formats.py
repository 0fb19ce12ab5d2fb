"""Readers and writers over small files."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from lumispan.sources import formats


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text) if isinstance(text, str) else p.write_bytes(text)
    return str(p)


def test_otlp_json_and_back(spark, tmp_path):
    span = {"traceId": "ab" * 16, "spanId": "01" * 8, "parentSpanId": "", "name": "/api", "kind": 2, "startTimeUnixNano": "1000000000000", "endTimeUnixNano": "1000005000000", "status": {"code": 2}, "attributes": [{"key": "http.code", "value": {"intValue": "200"}}]}
    child = span | {"spanId": "02" * 8, "parentSpanId": "01" * 8, "name": "SELECT", "kind": "SPAN_KIND_CLIENT", "status": {}, "endTimeUnixNano": "999"}
    body = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "front"}}]}, "scopeSpans": [{"spans": [span, child]}]}]}
    path = put(tmp_path, "a.json", json.dumps(body) + "\nnot json\n" + json.dumps(body) + "\n")
    assert formats.detect_format(spark, path) == "otlp"
    rows = formats.read_otlp_json(spark, path).dropDuplicates(["trace_id", "span_id"]).orderBy("span_id").collect()
    assert [(r["service"], r["operation"], r["kind"], r["status"], r["dur_us"]) for r in rows] == [("front", "/api", "SERVER", "2", 5000), ("front", "SELECT", "CLIENT", "0", 0)]
    assert rows[0]["attrs"] == {"http.code": "200"} and rows[0]["parent_span_id"] is None and rows[1]["parent_span_id"] == "01" * 8
    out = str(tmp_path / "out")
    formats.write_otlp(formats.read_otlp_json(spark, path).dropDuplicates(["trace_id", "span_id"]), out, 2)
    again = formats.read_otlp_json(spark, out).select("trace_id", "span_id", "kind", "status", "start_us", "dur_us").collect()
    assert len(again) == 2 and {r["kind"] for r in again} == {"SERVER", "CLIENT"}


def test_otlp_protobuf(spark, tmp_path):
    def field(n, v):
        if isinstance(v, int):
            return _var(n << 3) + _var(v)
        return _var(n << 3 | 2) + _var(len(v)) + v

    def fixed(n, v):
        return _var(n << 3 | 1) + struct.pack("<Q", v)

    def _var(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    text = lambda k, v: field(1, k.encode()) + field(2, field(1, v.encode()))
    span = field(1, b"\xab" * 16) + field(2, b"\x01" * 8) + field(5, b"/api") + field(6, 2) + fixed(7, 10**12) + fixed(8, 10**12 + 5_000_000) + field(9, text("a", "b")) + field(15, field(3, 2))
    resource = field(1, field(1, text("service.name", "front"))) + field(2, field(2, span))
    path = put(tmp_path, "a.pb", field(1, resource))
    r = formats.read_spans(spark, path).first()
    assert (r["service"], r["operation"], r["kind"], r["status"], r["start_us"], r["dur_us"], r["attrs"]) == ("front", "/api", "SERVER", "2", 10**9, 5000, {"a": "b"})


def test_jaeger(spark, tmp_path):
    body = {"data": [{"traceID": "abcdef1234567890", "spans": [
        {"traceID": "abcdef1234567890", "spanID": "1", "operationName": "/a", "startTime": 5, "duration": 7, "processID": "p1", "references": [], "tags": [{"key": "error", "type": "bool", "value": True}]},
        {"traceID": "abcdef1234567890", "spanID": "2", "operationName": "/b", "startTime": 6, "duration": 2, "processID": "p2", "references": [{"refType": "FOLLOWS_FROM", "spanID": "9"}, {"refType": "CHILD_OF", "spanID": "1"}], "tags": [{"key": "x", "type": "string", "value": "y"}]},
    ], "processes": {"p1": {"serviceName": "front"}, "p2": {"serviceName": "back"}}}]}
    path = put(tmp_path, "j.json", json.dumps(body))
    assert formats.detect_format(spark, path) == "jaeger"
    rows = formats.read_spans(spark, path).orderBy("span_id").collect()
    assert [(r["service"], r["status"], r["attrs"]) for r in rows] == [("front", "2", {}), ("back", "0", {"x": "y"})]
    assert rows[1]["parent_span_id"] == rows[0]["span_id"] == "1".rjust(16, "0")


def test_trace_csv(spark, tmp_path):
    head = "time,traceID,spanID,serviceName,methodName,operationName,startTimeMillis,startTime,duration,statusCode,parentSpanID,customTag\n"
    rows = "x,1,a,frontend,GET,/api,1,1705353846000000,5000,0.0,,t\nx,1,b,payment,POST,Process,1,1705353846000001,10,2.0,a,\nx,,c,s,m,o,1,1,1,0,,\nx,2,d,s,m,o,1,bad,1,0,,\n"
    got = formats.read_spans(spark, put(tmp_path, "t.csv", head + rows)).orderBy("span_id").collect()
    assert [(r["service"], r["status"], r["dur_us"]) for r in got] == [("frontend", "0", 5000), ("payment", "2", 10)]
    assert got[0]["attrs"] == {"method.name": "GET", "customTag": "t"} and got[1]["attrs"] == {"method.name": "POST"}
    with pytest.raises(ValueError, match="traceID"):
        formats.read_trace_csv(spark, put(tmp_path, "bad.csv", "spanID\n1\n"))


def test_flat_csv(spark, tmp_path):
    head = "trace_id,span_id,parent_span_id,start_time_us,duration_us,depth,num_siblings,minute_bucket,extra\n"
    got, wide = formats.read_flat_csv(spark, put(tmp_path, "f.csv", head + "t,a,,100,5,0,0,1,x\nt,b,a,130,5,1,1,1,\n"), 1)
    rows = got.orderBy("span_id").collect()
    assert [r["start_offset_us"] for r in rows] == [0, 30] and [r["is_root"] for r in rows] == [True, False]
    assert wide == ["extra"] and rows[1]["extra"] == "<NONE>"
    assert got.where(F.col("extra") == "x").count() == 1
