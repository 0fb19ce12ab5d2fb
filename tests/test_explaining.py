"""Shapley values against all subsets, mixtures against a plain version."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumispan.operators import analysis, modes, shapley


@pytest.fixture(scope="module")
def fitted(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 5)).round(2)
    y = np.where(x[:, 0] > 0, x[:, 1] * 2, x[:, 2]) + (x[:, 0] > 1) * x[:, 3]
    names = ("a", "b", "c", "d", "e")
    rows = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id bigint, a double, b double, c double, d double, e double, delta double")
    rows = rows.withColumn("e", F.when(F.col("id") % 3 > 0, F.col("e")))
    return rows, names, *analysis.boosted(rows, names, trees=6)


def plain_value(ways, x, known):
    """What the trees expect of a row of which only ``known`` features are known."""
    total = 0.0
    for w in ways:
        p = 1.0
        for f, lo, hi, share in zip(w.features, w.low, w.high, w.share):
            p *= (lo < x[f] <= hi) if f in known else share
        total += w.value * p
    return total


def test_shapley_values_sum_to_predictions_and_equal_all_subsets(spark, fitted):
    rows, names, model, prepared = fitted
    got = {r["id"]: r for r in shapley.shapley_values(rows, model, names, "id").collect()}
    predicted = model.transform(prepared).select(*names, "prediction").collect()
    order = rows.collect()
    assert len(got) == len(order)
    for r, p in zip(order, predicted):
        assert got[r["id"]]["base"] + sum(got[r["id"]][n] for n in names) == pytest.approx(p["prediction"])
    assert got[0]["base"] == pytest.approx(np.mean([p["prediction"] for p in predicted]), abs=1e-6)
    ways = shapley.model_ways(model, spark)
    for r in order[:6]:
        x = [r[n] or 0.0 for n in names]
        for i, n in enumerate(names):
            others = [j for j in range(len(names)) if j != i]
            phi = sum(
                factorial(k) * factorial(len(others) - k) / factorial(len(names)) * (plain_value(ways, x, {*s, i}) - plain_value(ways, x, {*s}))
                for k in range(len(others) + 1) for s in combinations(others, k)
            )
            assert got[r["id"]][n] == pytest.approx(phi, abs=1e-9)
    top = {r["feature"]: r["importance"] for r in shapley.importance(shapley.shapley_values(rows, model, names, "id"), names).collect()}
    assert top["e"] < min(top[n] for n in "abc")


def plain_mixture(x, k, rounds=200):
    """The same variational rounds over all values at once."""
    x = np.sort(np.asarray(x, dtype=float))
    cuts = np.percentile(x, [100 * i / k for i in range(1, k)])
    r = np.eye(k)[(x[:, None] > cuts).sum(axis=1)]
    prior = (x.mean(), max(x.var(ddof=1), 1e-6))
    fit = None
    for _ in range(rounds):
        after = modes.posterior(r.sum(axis=0), r.T @ x, r.T @ (x * x), prior)
        if fit is not None and np.abs(after.weights - fit.weights).max() + (np.abs(after.means - fit.means) / after.stds).max() < modes.TOLERANCE:
            return after
        fit = after
        log = fit.constants() - 0.5 * (x[:, None] - fit.means) ** 2 / fit.variances
        e = np.exp(log - log.max(axis=1, keepdims=True))
        r = e / e.sum(axis=1, keepdims=True)
    return fit


def test_digamma():
    assert modes.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525890])


def test_modes_are_found_and_values_come_back(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 1, 300), r.normal(20, 0.5, 200), r.normal(60, 3, 100)]).round(3)
    y = np.repeat([5.0], 600)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(600, None, 5.0)], "id bigint, x double, y double")
    codes, fits = modes.normalised(rows, {"x": F.col("x"), "y": F.col("y")}, ["id"])
    want = plain_mixture(x, 3)
    assert fits["x"].means == pytest.approx(want.means, abs=1e-3) and fits["x"].weights == pytest.approx(want.weights, abs=1e-3)
    assert sorted(fits["x"].means) == pytest.approx([0, 20, 60], abs=1.5)
    back = {v["id"]: v for v in codes.select("id", "x", "y", modes.decoded(F.col("x"), fits["x"]).alias("bx"), modes.decoded(F.col("y"), fits["y"]).alias("by")).collect()}
    assert back[600]["x"] is None and all(back[i]["by"] == pytest.approx(5.0, abs=0.01) for i in range(600))
    for i, v in enumerate(x):
        assert -1 <= back[i]["x"]["alpha"] <= 1
        if abs(back[i]["x"]["alpha"]) < 1:
            assert back[i]["bx"] == pytest.approx(v)
    assert sum(abs(back[i]["x"]["alpha"]) == 1 for i in range(600)) < 6
