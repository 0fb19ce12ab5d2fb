"""Hand-computed cases for the trace operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumispan.operators import diagnosis, model, normalise, profiling, samplers, scoring, tree
from lumispan.operators import trace_queries as tq
from lumispan.schema import MINUTE_US, SPAN, ModelConfig


def make(spark, rows):
    return spark.createDataFrame([(*r, {}) if len(r) == 9 else r for r in rows], SPAN)


@pytest.fixture(scope="module")
def two_minutes(spark):
    rows = [
        ("1", "a", None, "frontend", "/api", "", "0", 1_000_000_000, 5000, {"code": "200"}),
        ("1", "b", "a", "backend", "SELECT", "", "0", 1_000_001_000, 3000, {"code": "200"}),
        ("2", "c", None, "frontend", "/checkout", "", "0", 1_060_000_000, 8000, {}),
        ("2", "d", "c", "payment", "Process", "", "2", 1_060_001_000, 4000, {"code": "500"}),
    ]
    return normalise.derived(make(spark, rows), MINUTE_US).cache()


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys[:-1]): r[keys[-1]] for r in df.collect()}


def test_rates_errors_durations(two_minutes):
    rate = as_dict(tq.totals(tq.rate_over_time(two_minutes, "minute")), "group_key", "n")
    assert rate[("all",)] == 4 and rate[("service:frontend",)] == 2
    assert as_dict(tq.rate_over_time(two_minutes, "minute"), "group_key", "minute", "n")[("all", 16)] == 2
    errors = as_dict(tq.errors_over_time(two_minutes, "minute"), "group_key", "minute", "n")
    assert errors[("all", 17)] == 1 and ("all", 16) not in errors and errors[("service:payment", 17)] == 1
    d = {(r["group_key"], r["minute"]): r for r in tq.durations_over_time(two_minutes, "minute").collect()}[("all", 16)]
    assert (d["p50"], d["p90"], d["p99"]) == pytest.approx((4000, 4800, 4980))


def test_graph_and_sizes(spark, two_minutes):
    edges = as_dict(tq.graph_edges(two_minutes, "minute"), "parent", "child", "weight")
    assert edges == {("frontend//api", "backend/SELECT"): 1, ("frontend//checkout", "payment/Process"): 1}
    forest = make(spark, [("t", "a", None, "s", "o", "", "0", 1, 1), ("t", "b", "a", "s", "o", "", "0", 2, 1), ("t", "c", "missing", "s", "o", "", "0", 3, 1)])
    assert sorted(r["span_count"] for r in tree.component_sizes(forest).collect()) == [1, 2]
    assert [r["span_id"] for r in tree.orphans(forest).collect()] == ["c"]


def test_error_trace_and_duplicates(spark, two_minutes):
    assert {r["trace_id"] for r in two_minutes.where("error_trace").collect()} == {"2"}
    twice = two_minutes.select("trace_id", "span_id", "service").withColumn("seq", F.lit(1))
    later = twice.withColumn("seq", F.lit(2)).withColumn("service", F.lit("new"))
    assert {r["service"] for r in normalise.last_wins(twice.unionByName(later), "seq").collect()} == {"new"}


def test_envelope_repair_and_remap(spark):
    s = make(spark, [("t", "p", None, "s", "o", "", "0", 1000, 1000), ("t", "c", "p", "s", "o", "", "0", 1100, 1900), ("t", "g", "c", "s", "o", "", "0", 900, 10)])
    got = {r["span_id"]: (r["start_us"], r["start_us"] + r["dur_us"]) for r in normalise.envelope_repaired(s).collect()}
    assert got == {"p": (900, 3000), "c": (900, 3000), "g": (900, 910)}
    long = make(spark, [("l", "x", None, "s", "o", "", "0", 5, MINUTE_US + 1)])
    moved = normalise.remapped(s.unionByName(long)).collect()
    assert {r["trace_id"] for r in moved} == {"t"} and all(0 <= r["start_us"] < MINUTE_US for r in moved)


def test_chunks_never_split_traces(two_minutes):
    per = normalise.chunks(two_minutes, 2).groupBy("trace_id").agg(F.countDistinct("chunk").alias("n"))
    assert per.where("n > 1").isEmpty()


def test_ks_of_equal_samples_is_one_step(spark):
    s = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "service string, dur_us bigint")
    assert diagnosis.ks_distance(s, s).first()["ks"] == pytest.approx(1 / 3)
    rng = np.random.default_rng(1)
    for _ in range(3):
        x, y = sorted(rng.integers(0, 9, 12).tolist()), sorted(rng.integers(0, 9, 7).tolist())
        i = j = 0
        top = 0.0
        while i < len(x) or j < len(y):
            a = (i + 1) / len(x) if i < len(x) else 1.0
            b = (j + 1) / len(y) if j < len(y) else 1.0
            top = max(top, abs(a - b))
            if j >= len(y) or (i < len(x) and x[i] <= y[j]):
                i += 1
            else:
                j += 1
        f = lambda v: spark.createDataFrame([("s", k) for k in v], "service string, dur_us bigint")
        assert diagnosis.ks_distance(f(x), f(y)).first()["ks"] == pytest.approx(top)


def test_cusum_alarms_on_a_shift(spark):
    values = [1.0, 1.1, 0.9, 1.0, 1.05, 0.95, 1.0, 1.1, 0.9, 1.0, 1.0, 1.0, 2.0, 2.0]
    s = spark.createDataFrame([("a", "mean", i, v) for i, v in enumerate(values)], "service string, signal string, time bigint, value double")
    alarms = [r["time"] for r in diagnosis.cusum(s).where("alarm").orderBy("time").collect()]
    assert alarms == [12, 13]
    report = diagnosis.detection(diagnosis.cusum(s), 12, "a").first()
    assert report["detected"] and report["delay"] == 0 and report["false_alarms"] == 0 and report["ac1"] == 1
    flat = s.withColumn("value", F.lit(1.0))
    assert diagnosis.cusum(flat).isEmpty()


def test_rank_loses_dangling_mass(spark):
    nodes = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "service string, preference double")
    edges = spark.createDataFrame([("a", "b", 3)], "caller string, callee string, weight bigint")
    got = as_dict(diagnosis.personalised_rank(nodes, edges), "service", "score")
    assert got[("a",)] == pytest.approx(0.075, abs=1e-6) and got[("b",)] == pytest.approx(0.075 + 0.85 * 0.075, abs=1e-5)


def test_metrics(spark):
    one = lambda v: spark.createDataFrame([(float(x),) for x in v], "v double")
    w = lambda a, b: scoring.wasserstein(one(a), one(b), "v").first()["distance"]
    assert w([0.0, 0, 0], [1.0, 1, 1]) == pytest.approx(1) and w([1.0, 2, 3, 4], [2.0, 3, 4, 5]) == pytest.approx(1) and w([5.0], [5.0]) == 0
    from lumispan.functions.expressions import root_cause_of, symmetric_error

    pairs = spark.createDataFrame([(100.0, 100.0), (100.0, 0.0), (0.0, 0.0), (0.0, 50.0), (100.0, 50.0)], "a double, b double")
    got = [r[0] for r in pairs.select(symmetric_error(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([0, 100, 0, 100, 100 / 3])
    names = spark.createDataFrame([("checkoutservice_cpu",), ("my_service",)], "s string").select(root_cause_of(F.col("s"))).collect()
    assert [r[0] for r in names] == ["checkoutservice", "my_service"]


def test_graph_distance(spark):
    e = lambda w: spark.createDataFrame([(1, "a", "b", w)], "bucket bigint, parent string, child string, weight bigint")
    n = lambda *x: spark.createDataFrame([(1, i) for i in x], "bucket bigint, node string")
    assert scoring.graph_report(e(10), e(15), n("a", "b"), n("a", "b")).first()["distance"] == 5
    assert scoring.graph_report(e(10), e(10), n("a", "b"), n("a", "b", "c")).first()["distance"] == 1


def test_effect_size(spark):
    rows = [("f", "x" if i < 5 else "y", i, {}) for i in range(10)]
    s = spark.createDataFrame(rows, "feature string, kind string, dur_us bigint, attrs map<string,string>")
    got = profiling.attribute_effect(s, ("kind",)).first()
    h = 12 / (10 * 11) * (15**2 / 5 + 40**2 / 5) - 33
    assert got["eta2"] == pytest.approx(h / 9)
    assert profiling.attribute_effect(s.where("dur_us < 9"), ("kind",)).isEmpty()


def test_mixture_of_two(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(2, 0.1, 400), r.normal(6, 0.2, 600)])
    w, m, v = model.gaussian_mixture(x, 2)
    assert sorted(m) == pytest.approx([2, 6], abs=0.05) and sorted(w) == pytest.approx([0.4, 0.6], abs=0.02)
    w, m, v = model.gaussian_mixture(np.array([3.0]), 3)
    assert (w, m) == (pytest.approx([1.0]), pytest.approx([3.0]))


def test_head_sampling_rate(spark):
    s = spark.range(4000).select(F.col("id").cast("string").alias("trace_id"))
    n = samplers.head(s, 4).count()
    assert 850 < n < 1150 and samplers.head(s, 1).count() == 4000 and samplers.head(s, 4).count() == n


def test_vocabulary(spark):
    f = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b")], "bucket bigint, feature string")
    v = model.node_vocabulary(f)
    assert as_dict(v, "feature", "node_idx") == {("a",): 0, ("b",): 1}
    more = model.extended(v, spark.createDataFrame([(1, "0"), (1, "a")], "bucket bigint, feature string"))
    assert as_dict(more, "feature", "node_idx") == {("a",): 0, ("b",): 1, ("0",): 2}
    unknown = model.encoded(spark.createDataFrame([(1, "z")], "bucket bigint, feature string"), v)
    assert unknown.first()["node_idx"] == 0


def test_config_checks():
    with pytest.raises(ValueError):
        ModelConfig(offset_model="cubic")
    assert ModelConfig(dependent=("kind", "k")).dependent == ("k",)


def test_rebuilt_tree(spark):
    rows = spark.createDataFrame([("t", "a", 0), ("t", "b", 1), ("t", "c", 1), ("t", "d", 2), ("t", "e", 2), ("t", "f", 2)], "trace_id string, span_id string, depth bigint")
    got = as_dict(tree.rebuilt(rows), "span_id", "parent_span_id")
    assert got == {("a",): None, ("b",): "a", ("c",): "a", ("d",): "b", ("e",): "c", ("f",): "b"}
