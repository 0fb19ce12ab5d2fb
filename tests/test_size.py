"""What keeps work in proportion to the spans: they are derived once, and Python holds a piece of a file."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumispan.operators import analysis, model_state, modes, tree
from lumispan.plans import queries as plans
from lumispan.sources import formats, protobuf
from lumispan.sources.tables import events_as_spans

SF = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


@pytest.mark.parametrize(
    "name, module, function",
    [(n, analysis, "query_context") for n in ("query_context", "context_by_attribute", "failure_analysis", "feature_importance", "shapley_importance", "failure_sections")]
    + [(n, model_state.m, "annotated") for n in ("model_size", "generated_spans", "generated_percentile", "generated_templates", "generated_counts", "model_merged", "model_store")]
    + [("templates", tree, "positioned"), ("mode_normalised", modes, "normalised")],
)
def test_spans_that_are_read_again_are_stored(spark, monkeypatch, name, module, function):
    def seen(spans, *_, **__):
        raise Seen(",".join(spans.inputFiles()))

    monkeypatch.setattr(module, function, seen)
    with pytest.raises(Seen) as files:
        entry.queries()[name](spark, SF).count()
    assert "/spans-" in str(files.value) and "events.parquet" not in str(files.value)


@pytest.mark.parametrize("name, module, function", [("feature_importance", analysis, "boosted"), ("shapley_importance", analysis, "boosted"), ("failure_sections", analysis, "failure_analysis")])
def test_what_is_explained_is_stored(spark, monkeypatch, name, module, function):
    def seen(*given, **__):
        raise Seen([",".join(x.inputFiles()) for x in given if hasattr(x, "inputFiles")])

    monkeypatch.setattr(module, function, seen)
    with pytest.raises(Seen) as files:
        entry.queries()[name](spark, SF)
    found = files.value.args[0]
    assert any("/analysed-" in f for f in found) if function == "boosted" else any("/context-" in f for f in found) and any("/totals-" in f for f in found)


def test_protobuf_files_are_read_in_pieces(spark, monkeypatch, tmp_path):
    s = events_as_spans(spark, SF).limit(300)
    short = {c: F.when(F.col(c).isNotNull(), F.substring(F.md5(F.col(c)), 1, 16)) for c in ("span_id", "parent_span_id")}
    protobuf.write_otlp_proto(s.withColumns({"trace_id": F.md5("trace_id"), **short}), str(tmp_path / "p"), 3)
    whole = sorted(map(str, formats.read_otlp_proto(spark, str(tmp_path / "p" / "*.pb")).collect()))
    monkeypatch.setattr(formats, "BLOCK", 101)
    assert sorted(map(str, formats.read_otlp_proto(spark, str(tmp_path / "p" / "*.pb")).collect())) == whole and len(whole) == 300
    content = b"".join((tmp_path / "p" / f"chunk_{i:04d}.pb").read_bytes() for i in range(1))
    pieces = (pd.DataFrame({"at": [i + 1], "block": [content[i : i + 13]]}) for i in range(0, len(content), 13))
    assert list(formats._streamed(pieces)) == list(formats._fields(content))


def test_responsibilities_of_modes(spark):
    x = np.array([-3.0, 0.1, 0.2, 5.0, 900.0])
    fit = modes.posterior(np.array([3.0, 2.0, 1.0]), np.array([1.0, 9.0, 800.0]), np.array([2.0, 60.0, 640_100.0]), (100.0, 50_000.0))
    counts = spark.createDataFrame([("a", float(v), 2) for v in x], "column string, x double, c bigint")
    log = fit.constants() - 0.5 * (x[:, None] - fit.means) ** 2 / fit.variances
    want = np.exp(log - log.max(axis=1, keepdims=True))
    want /= want.sum(axis=1, keepdims=True)
    rows = modes._shared(counts, {"a": fit}, 3)
    got = np.array([[r["r0"], r["r1"], r["r2"]] for r in rows.orderBy("x").collect()])
    assert np.allclose(got, want)
    sums = modes._sums(rows, 3)["a"]
    assert np.allclose(sums[2], (2 * want * x[:, None] ** 2).sum(axis=0))
    assert "transform" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()


def test_kept_spans_are_the_spans(spark):
    kept, plain = plans.kept_spans(spark, SF), plans.spans(spark, SF)
    assert kept.schema.names == plain.schema.names and sorted(map(str, kept.collect())) == sorted(map(str, plain.collect()))
