"""Merged states, the store of versions, draws, numbers, posting lists, attribute keys, cumulative sums, against plain versions."""

import statistics
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumispan.functions import expressions as ex
from lumispan.operators import analysis, diagnosis, model, postings, trace_queries
from lumispan.operators.draws import draw_table, drawn
from lumispan.operators.generate import generate, generated_counts
from lumispan.operators.model_state import ModelState, state_of
from lumispan.operators.model_store import ModelStore
from lumispan.operators.normalise import derived
from lumispan.operators.numbering import numbered
from lumispan.schema import MINUTE_US, SPAN, ModelConfig


@pytest.fixture(scope="module")
def few_spans(spark):
    """Sixty traces in two minutes: a root, children of two kinds, some with a child of their own; attributes that hide columns."""
    r = np.random.default_rng(2)
    rows = []
    for t in range(60):
        at = int(r.integers(0, 2)) * MINUTE_US + int(r.integers(0, 1_000_000))
        op = f"op{t % 3}" if t < 40 else f"late{t % 2}"
        rows.append((f"t{t:02}", "r", None, "front", op, "SERVER", "2" if t % 7 == 0 else "0", at, 50_000 + t, {"k": f"v{t % 4}", "empty": ""}))
        for i in range(int(r.integers(0, 4))):
            attrs = {"k": f"v{i}"} if i else {"k": "", "kind": "HIDDEN", "status": ""}
            rows.append((f"t{t:02}", f"c{i}", "r", f"back{i % 2}", "work", "CLIENT", "0", at + 100 * i, 1000 + 10 * i + t % 5, attrs))
            if t % 2:
                rows.append((f"t{t:02}", f"c{i}x", f"c{i}", "db", "get", "CLIENT", "0", at + 100 * i + 5, 200 + t % 3, None))
    path_free = spark.createDataFrame(rows, SPAN)
    return derived(path_free, MINUTE_US)


def part(s, of, i):
    return s.where(F.pmod(F.crc32("trace_id"), F.lit(of)) == i)


def rows_of(df, digits=9):
    columns = sorted(df.columns)
    plain = lambda v: round(v, digits) if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, list) else v
    return sorted((repr([plain(r[c]) for c in columns]) for r in df.collect()))


@pytest.mark.parametrize("config", [
    ModelConfig(dependent=("k",)),
    ModelConfig(offset_model="percentile", offset_value="absolute", topology_mode="template", dependent=("k",)),
])
def test_merged_states_give_the_model_of_the_whole(spark, few_spans, config):
    parts = [state_of(part(few_spans, 2, i), config) for i in range(2)]
    merged = parts[0].merged(parts[1])
    got, want = merged.finalised(), model.train(few_spans, config)
    for name in want.tables:
        if name != "vocabulary":
            assert rows_of(got.tables[name]) == rows_of(want.tables[name]), name
    known = rows_of(parts[0].vocabulary)
    assert set(known) <= set(rows_of(merged.vocabulary))  # numbers that were given stay
    assert rows_of(merged.vocabulary.select("bucket", "feature")) == rows_of(want.tables["vocabulary"].select("bucket", "feature"))
    n = merged.vocabulary.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("node_idx").alias("d"), F.max("node_idx").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in n)
    with pytest.raises(ValueError):
        parts[0].merged(ModelState({}, parts[1].vocabulary, ModelConfig()))


@pytest.mark.parametrize("topology", ["edge", "template"])
def test_store_equals_training_on_all(spark, few_spans, tmp_path, topology):
    config = ModelConfig(topology_mode=topology, dependent=("k",))
    store = ModelStore(spark, str(tmp_path / "store"), config)
    assert store.versions() == [] and store.vocabulary().count() == 0
    first = few_spans.where("trace_id < 't40'")
    for i in range(2):
        store.append(state_of(part(first, 2, i), config))
    base = {r["feature"]: r["node_idx"] for r in store.vocabulary().collect()}
    assert sorted(base.values()) == list(range(len(base)))
    (tmp_path / "store" / "version=00000002").mkdir()  # begun by a writer that was lost
    assert store.append(state_of(few_spans.where("trace_id >= 't40'"), config)) == 3
    delta, tables = store.delta(1)
    assert delta.count() > 0 and delta.agg(F.min("node_idx")).first()[0] == len(base)
    assert sum(r["n"] for r in tables["start"].collect()) == 20
    assert {r["feature"]: r["node_idx"] for r in store.vocabulary(upto=1).collect()} == base
    want = model.train(few_spans, config)
    for name, t in store.model().tables.items():
        assert rows_of(t) == rows_of(want.tables[name]), name
    assert rows_of(store.state(upto=1).tables["start"]) == rows_of(model.start_table(model.annotated(first)))
    version = store.compacted()
    assert store.needed() == [version] and store.delta(3)[1] == {}
    store.append(state_of(few_spans.where("trace_id = 't00'").withColumn("trace_id", F.lit("new")), config))
    assert store.needed() == [version, version + 1]
    assert store.model().tables["bucket_meta"].agg(F.sum("traces")).first()[0] == 61
    assert sum(r["n"] for r in store.delta(3)[1]["start"].collect()) == 1
    assert sum(r["n"] for r in store.delta(-1)[1]["start"].collect()) == 61


def test_saved_states_load(spark, few_spans, tmp_path):
    config = ModelConfig(dependent=("k",))
    state = state_of(few_spans, config)
    state.save(str(tmp_path / "s"))
    back = ModelState.load(spark, str(tmp_path / "s"), config)
    assert all(rows_of(back.tables[n]) == rows_of(state.tables[n]) for n in state.tables)


def test_draws_fall_on_the_shares(spark):
    r = np.random.default_rng(9)
    weights = [("a", f"v{i:03}", int(w)) for i, w in enumerate(r.integers(1, 50, 200))] + [("b", "only", 3)] + [("c", f"v{i}", w) for i, w in enumerate((1, 10**9, 1))] + [("d", "x", 0), ("d", "y", 2)]
    table = draw_table(spark.createDataFrame(weights, "key string, v string, w bigint"), ["key"], ["v"], "w")
    draws = [(k, float(u)) for k in "abcd" for u in [*r.random(500), 1e-12, 1 - 1e-12]] + [("z", 0.5)]
    got = spark.createDataFrame(draws, "key string, u double").join(table, "key", "left").select("key", "u", drawn(F.col("u"))["v"].alias("v")).collect()
    assert len(got) == len(draws)
    for row in got:
        own = sorted((v, w) for k, v, w in weights if k == row["key"] and w)
        upto = np.cumsum([w for _, w in own]) / sum(w for _, w in own) if own else []
        assert row["v"] == (own[int(np.searchsorted(upto, row["u"], side="right"))][0] if own else None)


def test_generation_repeats_and_fits_its_bounds(few_spans):
    config = ModelConfig(dependent=("k",))
    m = model.train(few_spans, config)
    out = generate(m)
    assert "parent" not in out.columns and rows_of(out) == rows_of(generate(m))
    seen = {(r["feature"], r["k"]) for r in out.collect()}
    real = {(r["feature"], r["k"] or "") for r in few_spans.select("feature", F.col("attrs")["k"].alias("k")).collect()}
    assert {f for f, _ in seen} <= {f for f, _ in real} and {k for _, k in seen} <= {k for _, k in real}
    counted = {r["bucket"]: (r["traces"], r["spans"]) for r in generated_counts(m).collect()}
    assert counted == {r["bucket"]: (r["t"], r["n"]) for r in out.groupBy("bucket").agg(F.countDistinct("trace_id").alias("t"), F.count("*").alias("n")).collect()}
    assert out.where("dur_us < 1").isEmpty() and out.where("parent_span_id is null").count() == few_spans.where("is_root").count()


def test_numbers_are_consecutive_and_in_order(spark):
    rows = [(x,) for x in [5, 3, 3, 9, 1, 7, 100, -4] * 40]
    got = sorted((r["n"], r["x"]) for r in numbered(spark.createDataFrame(rows, "x int").repartition(5), ["x"], "n", 10).collect())
    assert [n for n, _ in got] == list(range(10, 10 + len(rows))) and [x for _, x in got] == sorted(x for x, in rows)


def plain_keys(row, names=None):
    attrs = {k: v for k, v in (row["attrs"] or {}).items() if names is None or k in names}
    entries = sorted([f"{k}:{v}" for k, v in attrs.items() if v] + [f"{c}:{row[c]}" for c in ("kind", "operation", "service", "status") if row[c] and c not in attrs])
    return ["all", *entries, *[f"{a}!@#{b}" for a, b in combinations(entries, 2)]]


@pytest.mark.parametrize("names", [None, ("k",)])
def test_attribute_keys(few_spans, names):
    rows = few_spans.collect()
    want = Counter((k, r["bucket"]) for r in rows for k in plain_keys(r, names))
    got = {(r["group_key"], r["bucket"]): r["n"] for r in trace_queries.rate_over_time(few_spans, attributes=names).collect()}
    assert got == dict(want)
    durations = {}
    for r in rows:
        for k in plain_keys(r, names):
            durations.setdefault((k, r["bucket"]), []).append(r["dur_us"])
    for r in trace_queries.durations_over_time(few_spans, attributes=names).collect():
        d = durations[r["group_key"], r["bucket"]]
        assert r["n"] == len(d) and r["p50"] == pytest.approx(np.percentile(d, 50)) and r["p99"] == pytest.approx(np.percentile(d, 99))


@pytest.mark.parametrize("few", [0, 3, 512])
def test_posting_lists_select_what_a_scan_does(spark, few_spans, few, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 64)
    rows = few_spans.collect()
    want = {}
    for r in rows:
        for k in plain_keys(r):
            want.setdefault(k, set()).add((r["trace_id"], r["span_id"]))
    keys = [*want, "service:nobody", "service:front!@#service:back0", "kind:CLIENT!@#kind:CLIENT", "kind:CLIENT!@#k:v1!@#service:back1"]
    want |= {"kind:CLIENT!@#kind:CLIENT": want["kind:CLIENT"], "kind:CLIENT!@#k:v1!@#service:back1": {x for x in want["k:v1!@#kind:CLIENT"] if x in want["service:back1"]}}
    index = postings.posting_index(few_spans, few=few)
    asked = spark.createDataFrame([(k,) for k in keys], "group_key string")
    assert {r["group_key"]: r["n"] for r in index.counts(asked).collect()} == {k: len(want.get(k, ())) for k in keys}
    got = {}
    for r in index.members(asked).collect():
        got.setdefault(r["group_key"], []).append((r["trace_id"], r["span_id"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if k in keys}
    scanned = {(r["trace_id"], r["span_id"]) for r in analysis.matching(few_spans, "service:back1!@#operation:work").collect()}
    assert set(got["operation:work!@#service:back1"]) == scanned


def plain_alarms(points):
    if len(points) < 11 or statistics.stdev(points[:11]) <= 0:
        return []
    mean, sd = statistics.mean(points[:11]), statistics.stdev(points[:11])
    up = down = 0.0
    out = []
    for i, v in enumerate(points[11:], 11):
        z = (v - mean) / sd
        up, down = max(0.0, up + z - 0.5), min(0.0, down + z + 0.5)
        size = max(up, -down)
        out.append((i, round(size, 6), size > 5))
        if size > 5:
            up = down = 0.0
    return out


def test_cumulative_sums_against_a_plain_fold(spark):
    r = np.random.default_rng(4)
    series = {f"s{i:03}": [float(x) for x in r.normal(0, 1, int(r.integers(1, 40)))] for i in range(120)}
    series |= {"flat": [1.0] * 30, "eleven": [float(i) for i in range(11)], "ten": [float(i) for i in range(10)], "jump": [0.0, 1.0] * 6 + [9.0] * 5}
    rows = [(s, "mean", i, v) for s, vs in series.items() for i, v in enumerate(vs)]
    sums = diagnosis.cusum(spark.createDataFrame(rows, "service string, signal string, time bigint, value double"))
    got = {}
    for x in sums.collect():
        got.setdefault(x["service"], []).append((x["time"], round(x["size"], 6), x["alarm"]))
    want = {s: plain_alarms(v) for s, v in series.items()}
    assert {s: sorted(v) for s, v in got.items()} == {s: v for s, v in want.items() if v}
    alarmed = {s: max(z for _, z, a in v if a) for s, v in want.items() if any(a for *_, a in v)}
    ranked = diagnosis.localised(sums).orderBy("rank").collect()
    assert [x["service"] for x in ranked] == sorted(alarmed, key=lambda s: (-alarmed[s], s))
    window = spark.createDataFrame([(i,) for i in range(40)], "bucket bigint")
    first = min(i for v in want.values() for i, _, a in v if a)
    for inject in (first, first + 3, 100):
        d = diagnosis.detection(sums, inject, "jump", window).first()
        early = sum(a and i < inject - 1 for v in want.values() for i, _, a in v) if inject < 40 else 0
        assert d["detected"] == (first >= inject - 1 and inject < 40) and d["false_alarms"] == early
        assert d["delay"] == (first - inject if d["detected"] else None) and d["false_alarm_rate"] == pytest.approx(early / inject)


def test_names_of_experiments_and_sections(spark):
    names = ["app_x_head_50_2", "head_7", "app_head_20_weighted_1", "a_model", "a_model_template_3", "model_wide", "tail", "app_hindsight", "s_sifter_10_1", "app_other_1"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").withColumn("e", ex.experiment(F.col("n")))
    got = {r["n"]: (tuple(r["e"]) if r["e"] else None, r["c"]) for r in rows.select("n", "e", ex.experiment_class(F.col("e")).alias("c")).collect()}
    assert got == {
        "app_x_head_50_2": (("head", "50", "1:50", "2"), "Head"), "head_7": (("head", "head", "Head", "7"), None),
        "app_head_20_weighted_1": (("head", "20_weighted", "1:20", "1"), "Head"), "a_model": (("model", "model", "Model", "1"), "Model"),
        "a_model_template_3": (("model", "template", "Model template", "3"), "Model by template"), "model_wide": (("model", "wide", "Model wide", "1"), None),
        "tail": (("tail", "tail", "Tail", "1"), "Tail"), "app_hindsight": (("hindsight", "hindsight", "Hindsight", "1"), "Hindsight"),
        "s_sifter_10_1": (("sifter", "10", "Sifter 1:10", "1"), "Sifter"), "app_other_1": (None, None),
    }
    queries = ["rate_over_time::all", "duration_over_time_p90::a:b!@#c:d::e", "duration_over_time::x", "graph", "error_over_time::", "operation::o"]
    q = F.col("q")
    told = spark.createDataFrame([(x,) for x in queries], "q string").select(ex.query_section(q), ex.query_key(q), ex.section_kind(ex.query_section(q)), ex.section_percentile(ex.query_section(q))).collect()
    assert [tuple(r) for r in told] == [
        ("rate_over_time", "all", "rate", "-"), ("duration_over_time_p90", "a:b!@#c:d::e", "duration", "p90"), ("duration_over_time", "x", "duration", "-"),
        ("graph", "", "graph", "-"), ("error_over_time", "", "error", "-"), ("operation", "o", "operation", "-"),
    ]
