"""Protobuf files, folders of mixed formats, packed columns, reports: written, read back, and equal."""

import json

import pytest
from pyspark.sql import functions as F

from lumispan.functions.expressions import signature_value
from lumispan.operators import analysis, diagnosis, normalise, profiling, scoring
from lumispan.operators.generate import generate
from lumispan.operators.measure import Timings, measured_costs, per_core_second
from lumispan.operators.model import train
from lumispan.schema import SPAN, ModelConfig
from lumispan.sources import folders, formats, protobuf


@pytest.fixture(scope="module")
def plain_spans(spark):
    rows = []
    for t in range(12):
        trace = f"{t:032x}"
        rows.append((trace, f"{t:08x}00000001", None, "front", "GET /ä", "SERVER", "2" if t % 3 == 0 else "1", 1_000_000 * t, 900, {"k": f"v{t}", "none": ""}))
        rows += [(trace, f"{t:08x}0000001{i}", f"{t:08x}00000001", "back", "", "CLIENT" if i else "", "0", 1_000_000 * t + i, 0 if i else 300, {}) for i in range(t % 4)]
    return spark.createDataFrame(rows, SPAN)


def told(df):
    columns = [f.name for f in SPAN.fields]
    return sorted(repr([tuple(sorted((k, v) for k, v in (r[c] or {}).items() if v)) if c == "attrs" else r[c] for c in columns]) for r in df.collect())


def fnv(text):
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 % 2**32
    return h


def test_fnv(spark):
    texts = ["", "a", "foobar", "ü😀", "0" * 32]
    got = [r["h"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(protobuf.fnv1a(F.col("t")).alias("h")).collect()]
    assert got == [fnv(t) for t in texts] and got[1] == 0xE40C292C


def test_protobuf_files_hold_whole_traces(spark, plain_spans, tmp_path, monkeypatch):
    path = str(tmp_path / "pb")
    protobuf.write_otlp_proto(plain_spans, path, 4)
    names = sorted(p.name for p in (tmp_path / "pb").iterdir())
    assert names == [f"chunk_{c:04d}.pb" for c in sorted({fnv(f"{t:032x}") % 4 for t in range(12)})]
    back = formats.read_otlp_proto(spark, f"{path}/*.pb")
    assert told(back) == told(plain_spans)
    for name in names:
        found = {r["trace_id"] for r in formats.read_otlp_proto(spark, f"{path}/{name}").collect()}
        assert {fnv(t) % 4 for t in found} == {int(name[6:10])}
    none = str(tmp_path / "none")
    protobuf.write_otlp_proto(plain_spans.where("trace_id = ''"), none, 4)
    assert not list((tmp_path / "none").glob("*.pb")) if (tmp_path / "none").exists() else True
    with pytest.raises(Exception, match="hexadecimal"):
        protobuf.write_otlp_proto(plain_spans.withColumn("trace_id", F.lit("no number")), str(tmp_path / "bad"), 2)


def test_long_runs_become_several_messages(plain_spans, monkeypatch):
    monkeypatch.setattr(protobuf, "PER_MESSAGE", 2)
    rows = plain_spans.withColumn("chunk", F.lit(0)).orderBy("trace_id", "service").collect()
    out = list(protobuf.messages(iter(rows)))
    assert len(out) == 12 + sum(-(-(t % 4) // 2) for t in range(12)) and all(c == 0 for c, _ in out)


def test_generated_spans_are_written_and_read_back(spark, plain_spans, tmp_path):
    config = ModelConfig(dependent=("k",))
    out = generate(train(normalise.derived(plain_spans, config.bucket_us), config))
    spans = protobuf.spans_of_features(out, config)
    assert sorted({r["service"] for r in spans.collect()}) == ["back", "front"]
    assert {r["attrs"].get("k", "") for r in spans.where("service = 'front'").collect()} <= {f"v{t}" for t in range(12)}
    protobuf.write_otlp_proto(spans, str(tmp_path / "g"), 3)
    assert told(formats.read_otlp_proto(spark, str(tmp_path / "g" / "*.pb"))) == told(spans)


def test_a_folder_of_mixed_files(spark, plain_spans, tmp_path):
    path = tmp_path / "mixed"
    path.mkdir()
    parts = [plain_spans.where(F.pmod(F.conv(F.substring("trace_id", 31, 2), 16, 10).cast("int"), F.lit(4)) == i) for i in range(4)]
    requests = [r["value"] for r in formats.otlp_requests(parts[0]).collect()]
    (path / "a.json").write_text("\n".join(requests) + "\nnot json\n")
    (path / "b.json").write_text(json.dumps(json.loads(formats.otlp_requests(parts[1]).first()["value"]), indent=2))
    document = {"data": [d for r in folders.jaeger_documents(parts[2]).collect() for d in json.loads(r["value"])["data"]]}
    (path / "c.json").write_text(json.dumps(document, indent=1))
    protobuf.write_otlp_proto(parts[3], str(path), 1)
    got = folders.read_folder(spark, str(path)).select("trace_id", "span_id").collect()
    first = parts[1].where(F.col("trace_id") == json.loads((path / "b.json").read_text())["resourceSpans"][0]["scopeSpans"][0]["spans"][0]["traceId"])
    want = parts[0].unionByName(first).unionByName(parts[2]).unionByName(parts[3]).select("trace_id", "span_id").collect()
    assert sorted(got) == sorted(want)
    assert formats.detect_format(spark, str(path / "c.json")) == "jaeger" and formats.detect_format(spark, str(path / "b.json")) == "otlp"


def test_reports_merge_and_the_last_wins(spark, tmp_path):
    one = spark.createDataFrame([("rate", "head_4", "all", "fidelity", 1.0), ("rate", "head_4", "all", "mape", 2.0)], folders.REPORT)
    two = spark.createDataFrame([("rate", "head_4", "all", "fidelity", 3.0), ("size", "tail", "all", "bytes", 4.0)], folders.REPORT)
    formats.write_report(folders.merged_reports(one, two), str(tmp_path / "r"))
    got = {tuple(r) for r in folders.read_reports(spark, str(tmp_path / "r")).collect()}
    assert got == {("rate", "head_4", "all", "fidelity", 3.0), ("rate", "head_4", "all", "mape", 2.0), ("size", "tail", "all", "bytes", 4.0)}
    (tmp_path / "n.json").write_text(json.dumps({"reports": {"rate": {"head_4": {"all": {"fidelity": 3.0}}}}}))
    assert [tuple(r) for r in folders.nested_report(spark, str(tmp_path / "n.json")).collect()] == [("rate", "head_4", "all", "fidelity", 3.0)]


def test_small_sinks_and_helpers(spark, plain_spans, tmp_path):
    flat = plain_spans.select("trace_id", "span_id", "dur_us")
    formats.write_tsv(flat, str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == flat.count()
    formats.write_flat_csv(flat, str(tmp_path / "f"))
    assert spark.read.option("header", True).csv(str(tmp_path / "f")).columns == flat.columns
    s = normalise.derived(plain_spans)
    chunked = normalise.chunks(s, 5)
    formats.write_chunks(chunked.select("trace_id", "span_id", "bucket", "chunk"), str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.count() == s.count() and back.groupBy("trace_id").agg(F.countDistinct("chunk").alias("n")).where("n > 1").isEmpty()
    assert {tuple(r["attrs"]) for r in normalise.pruned(plain_spans, ["none"]).collect()} <= {("none",), ()}
    services = {r["s"] for r in s.select(signature_value(F.col("feature"), "service").alias("s")).collect()}
    assert services == {"front", "back"} and s.select(signature_value(F.col("feature"), "nothing").alias("v")).first()["v"] == ""
    assert analysis.ablations(("a", "b"), ("k",)) == [("a", ("b",), ("k", "a")), ("b", ("a",), ("k", "b"))]
    effect = spark.createDataFrame([("k", 0.3), ("l", 0.01)], "attribute string, eta2 double")
    assert [r["attribute"] for r in profiling.promoted(effect).collect()] == ["k"]
    ranking = spark.createDataFrame([("x", 1), ("y", 3)], "service string, rank int")
    assert tuple(diagnosis.hits(ranking, "y").first()) == (0, 0, 1, 1, 1) and tuple(diagnosis.hits(ranking, "z").first()) == (0,) * 5
    failed = spark.createDataFrame([(float(i), i + 1) for i in range(40)], "v double, place int")
    got = {r["scope"]: (r["n"], r["mean"], r["median"]) for r in scoring.distribution(failed, "v").collect()}
    assert got == {"all": (40, 19.5, 19.5), "worst": (20, 9.5, 9.5)}


def test_timings(spark, plain_spans, tmp_path):
    t = Timings(spark, str(tmp_path / "t"))
    back = t.run("all", plain_spans, analysis.span_bytes())
    t.run("none", plain_spans.where("trace_id = ''"), analysis.span_bytes())
    rows = {r["step"]: r for r in t.table().collect()}
    assert told(back) == told(plain_spans) and rows["all"]["rows"] == plain_spans.count() and rows["none"]["bytes"] == 0
    assert rows["all"]["bytes"] == plain_spans.agg(F.sum(analysis.span_bytes())).first()[0] and rows["all"]["seconds"] > 0
    sizes = analysis.stored_sizes("all", normalise.derived(plain_spans), normalise.derived(plain_spans)).unionByName(
        analysis.stored_sizes("never", normalise.derived(plain_spans), normalise.derived(plain_spans))
    )
    costs = {r["approach"]: r for r in measured_costs(sizes, t.table(), 2).collect()}
    assert costs["all"]["cpu_s"] == pytest.approx(2 * rows["all"]["seconds"]) and costs["never"]["cpu_s"] is None
    assert costs["all"]["dollars"] > costs["never"]["dollars"] > 0
    assert {r["step"]: r["rows_a_second"] > 0 for r in per_core_second(t.table()).collect()} == {"all": True, "none": False}


def test_a_path_is_told_by_what_it_holds(spark, plain_spans, tmp_path):
    for scenario, run in (("cart_cpu", 1), ("cart_cpu", 2), ("pay_loss", 1), ("pay_loss", 7)):
        folders.csv_rows(plain_spans, ("k",)).coalesce(1).write.option("header", True).csv(str(tmp_path / "runs" / scenario / str(run) / "traces.csv"))
    formats.write_otlp(plain_spans, str(tmp_path / "one"), 1)
    part = next((tmp_path / "one").glob("part-*"))
    (tmp_path / "files").mkdir()
    part.rename(tmp_path / "files" / "a.json")
    assert [folders.kind_of(spark, str(tmp_path / x)) for x in ("runs", "files", "files/a.json")] == ["runs", "folder", "otlp"]
    runs = folders.read_any(spark, str(tmp_path / "runs")).groupBy("scenario", "run").count().collect()
    assert sorted(map(tuple, runs)) == [(s, r, plain_spans.count()) for s, r in (("cart_cpu", "1"), ("cart_cpu", "2"), ("pay_loss", "1"))]
    assert told(folders.read_any(spark, str(tmp_path / "files"))) == told(folders.read_any(spark, str(tmp_path / "files" / "a.json"))) == told(plain_spans)
    with pytest.raises(ValueError):
        folders.scenario_runs(spark, str(tmp_path / "files"))


def test_packed_files(spark, tmp_path):
    import gzip

    long = b"".join(b'{"n": %d}\n' % i for i in range(300_000))
    (tmp_path / "a.gz").write_bytes(gzip.compress(long))
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"x\ny\n") + gzip.compress(b"z\n"))
    got = {r["file"].rsplit("/", 1)[1]: (r["raw_bytes"], r["lines"]) for r in folders.read_packed(spark, str(tmp_path)).collect()}
    assert got == {"a.gz": (len(long), 300_000), "b.gz": (6, 3)}
