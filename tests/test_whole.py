"""Small cases of the findings of a review: operators do the whole job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumispan.functions.expressions import hash32
from lumispan.operators import generate, model, normalise, samplers
from lumispan.plans.queries import queries
from lumispan.schema import MINUTE_US, SPAN, ModelConfig


def test_mixtures_are_fitted_on_all_roots(spark):
    r = np.random.default_rng(3)
    logs = np.concatenate([r.normal(5, 0.3, 900), r.normal(8, 0.4, 600), r.normal(11, 0.2, 1500)])
    d = np.floor(np.expm1(logs)).astype(int)
    rows = [(1, "hot", 2, f"t{i}", f"s{i}", int(x), True) for i, x in enumerate(d)] + [(1, "one", 0, "u", "v", 7, True)]
    a = spark.createDataFrame(rows, "bucket bigint, feature string, child_count bigint, trace_id string, span_id string, dur_us bigint, is_root boolean")
    w, m, v = model.gaussian_mixture(np.log1p(d.astype(float)), 3)
    for distinct in (10_000, 100):
        got = {x["feature"]: x for x in model.root_durations(a, ModelConfig(), distinct).collect()}
        assert (got["hot"]["n"], got["hot"]["lo"], got["hot"]["hi"], got["one"]["n"]) == (3000, d.min(), d.max(), 1)
        assert got["hot"]["weights"] == pytest.approx(w, abs=1e-6)
        assert got["hot"]["means"] == pytest.approx(m, abs=1e-6) and got["hot"]["variances"] == pytest.approx(v, abs=1e-6)
        assert got["one"]["means"] == pytest.approx([np.log(8)])


def test_template_mode_generates_whole_spans(spark):
    rows = []
    for t in range(3):
        at = 1_000_000 * (t + 1)
        rows += [
            (f"t{t}", "a", None, "front", "GET /a;b|c", "SERVER", "0", at, 9000, {"k": "x"}),
            (f"t{t}", "b", "a", "mid", "m", "SERVER", "0", at + 100, 4000, {"k": "y"}),
            (f"t{t}", "c", "a", "mid", "n", "SERVER", "0", at + 5000, 3000, {"k": "y"}),
            (f"t{t}", "d", "c", "db", "q", "CLIENT", "0", at + 5500, 1000, {"k": "z"}),
        ]
    s = normalise.derived(spark.createDataFrame(rows, SPAN), MINUTE_US)
    config = ModelConfig(topology_mode="template", dependent=("k",))
    out = generate.generate(model.train(s, config))
    edge = generate.generate(model.train(s, ModelConfig(dependent=("k",))))
    assert sorted(out.columns) == sorted(edge.columns)
    got = out.collect()
    assert len(got) == 12 and len({r["span_id"] for r in got}) == 12
    by_id = {r["span_id"]: r for r in got}
    op = lambda r: next(p[10:] for p in r["feature"].split("\0") if p.startswith("operation="))
    edges = sorted((op(by_id[r["parent_span_id"]]), op(r), r["k"]) for r in got if r["parent_span_id"])
    assert edges == sorted([("GET /a;b|c", "m", "y"), ("GET /a;b|c", "n", "y"), ("n", "q", "z")] * 3)
    for r in got:
        if r["parent_span_id"] is None:
            assert r["dur_us"] == 9000 and 1_000_000 <= r["start_us"] <= 3_000_000 and r["k"] == "x"
        else:
            p = by_id[r["parent_span_id"]]
            assert p["trace_id"] == r["trace_id"] and p["start_us"] <= r["start_us"] and r["start_us"] + r["dur_us"] <= p["start_us"] + p["dur_us"]


def test_sifter_is_one_fold(spark):
    r = np.random.default_rng(5)
    rows, chains = [], []
    for t in range(130):
        names = [str(x) for x in r.integers(0, 4 if t % 13 else 9, 7)]
        chains.append(names)
        rows += [(f"t{t:03d}", f"t{t}-{i}", f"t{t}-{i - 1}" if i else None, n, 1000 * t + i) for i, n in enumerate(names)]
    s = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, feature string, start_us bigint")
    got = {x["trace_id"]: x for x in samplers.sifter(s, 4).collect()}
    draws = {x["trace_id"]: x["u"] for x in s.select("trace_id", ((hash32("sifter", F.lit(42), F.col("trace_id")) + 0.5) / float(1 << 32)).alias("u")).collect()}
    number = {f: i for i, f in enumerate(sorted({n for c in chains for n in c}))}
    m, seen = samplers.PathModel(len(number)), []
    for t, names in enumerate(chains):
        c = [number[n] for n in names]
        loss = np.mean([m.learn(c[i : i + 5]) for i in range(3)])
        p = 1.0
        if len(seen) >= 50:
            least, last = min(seen[-50:]), seen[-50:]
            p = (loss - least) / (sum(last) - 50 * least + loss - least) * 51 / 4
        row = got[f"t{t:03d}"]
        assert row["loss"] == pytest.approx(loss) and row["kept"] == (draws[f"t{t:03d}"] < p)
        seen.append(loss)
    assert 50 < sum(x["kept"] for x in got.values()) < 130


def test_sifter_query_learns(spark):
    assert queries()["sifter_sample"](spark, "/root/testdata/sf0.001").where("loss > 0").count() > 0
