"""Trees deeper than 100 levels, wider than 10,000 children, and cycles."""

import pytest

from lumispan.operators import normalise, profiling, tree
from lumispan.schema import SPAN


@pytest.fixture(scope="module")
def deep(spark):
    rows = [("t", f"n{i}", f"n{i - 1}" if i else None, "s", f"o{i}", "", "0", 1000 - i, 1, {}) for i in range(151)]
    rows += [("c", "x", "y", "s", "x", "", "0", 5, 1, {}), ("c", "y", "x", "s", "y", "", "0", 3, 9, {}), ("c", "z", "y", "s", "z", "", "0", 1, 50, {})]
    return spark.createDataFrame(rows, SPAN)


def test_ancestors_of_any_distance(deep):
    got = [(r["span_id"], r["ancestor"], r["distance"]) for r in tree.closure(deep).collect()]
    assert sorted(got) == sorted((f"n{i}", f"n{j}", i - j) for i in range(151) for j in range(i))


def test_envelope_and_cover_of_a_deep_chain(deep):
    got = {r["span_id"]: (r["start_us"], r["dur_us"]) for r in normalise.envelope_repaired(deep).collect()}
    assert got["n0"] == (850, 151) and got["n150"] == (850, 1)
    assert (got["x"], got["y"], got["z"]) == ((5, 1), (3, 9), (1, 50))
    cover = {(r["parent"], r["child"]): r["weight"] for r in profiling.edge_cover(deep.where("trace_id = 't'")).collect()}
    assert cover[("s/o0", "s/o1")] == 150 and cover[("s/o149", "s/o150")] == 1


def test_templates_of_a_wide_parent(spark):
    rows = [("t", "r", None, "root", "", "", "0", 0, 9, {})]
    rows += [("t", f"k{i}", "r", {1000: "m", 10_000: "z"}.get(i, "a"), "", "", "0", i + 1, 1, {}) for i in range(10_001)]
    nodes = tree.templates(normalise.derived(spark.createDataFrame(rows, SPAN))).first()["nodes"]
    services = ["".join(p[8:] for p in n["feature"].split("\0") if p.startswith("service=")) for n in nodes]
    assert services[0] == "root" and services[1001] == "m" and services[10_001] == "z" and services.count("a") == 9999
