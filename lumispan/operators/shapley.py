"""Exact Shapley values of boosted trees, from the nodes that Spark saves with a model.

The value of a set of features is what a tree expects of a row when only they are known: at a split on another feature
both sides count by the rows that training sent there. Along the way to a leaf a feature counts once, with the interval
that its splits leave and the product of its shares. The sum over all sets of a way's features is a polynomial in their
number, so a leaf costs its depth squared a row. Values of a row sum to its prediction minus the mean prediction.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial, inf

import numpy as np
import pandas as pd
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import shared_folder


@dataclass(frozen=True)
class Way:
    """The way to a leaf: per feature on it the interval (low, high] that leads there, and its share of the rows."""

    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]
    value: float


def ways_of(nodes: dict[int, tuple], weight: float) -> list[Way]:
    """The ways of one tree. nodes: id -> (prediction, rows, left, right, feature, threshold); left is -1 at a leaf."""
    out, todo = [], [(0, {})]
    while todo:
        at, seen = todo.pop()
        prediction, rows, left, right, feature, threshold = nodes[at]
        if left < 0:
            f = tuple(sorted(seen))
            out.append(Way(f, *(tuple(seen[x][i] for x in f) for i in range(3)), weight * prediction))
            continue
        low, high, share = seen.get(feature, (-inf, inf, 1.0))
        todo.append((left, seen | {feature: (low, min(high, threshold), share * nodes[left][1] / rows)}))
        todo.append((right, seen | {feature: (max(low, threshold), high, share * nodes[right][1] / rows)}))
    return out


def model_ways(model: GBTRegressionModel, spark) -> list[Way]:
    """The ways of all trees of a model: as many as its trees have leaves, whatever it was fitted on."""
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    n = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", n["id"].alias("id"), n["prediction"].alias("prediction"), n["impurityStats"][0].alias("rows"), n["leftChild"].alias("left"),
        n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"),
    )
    trees: dict[int, dict[int, tuple]] = {}
    for r in rows.collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = tuple(r)[2:]
    weights = list(model.treeWeights)
    return [w for t, nodes in sorted(trees.items()) for w in ways_of(nodes, weights[t])]


def shapley(ways: list[Way], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Per row and feature the Shapley value, and the mean prediction that they are measured from."""
    out, mean = np.zeros(x.shape), 0.0
    for w in ways:
        k = len(w.features)
        mean += w.value * float(np.prod(w.share)) if k else w.value
        if not k:
            continue
        v = x[:, list(w.features)]
        holds = ((v > np.array(w.low)) & (v <= np.array(w.high))).astype(float)
        weight = np.array([factorial(s) * factorial(k - s - 1) / factorial(k) for s in range(k)])
        for i in range(k):
            sums = np.zeros((len(x), k))  # by how many of the others are known
            sums[:, 0] = 1.0
            for j in range(k):
                if j != i:
                    more = np.zeros_like(sums)
                    more[:, 1:] = sums[:, :-1] * holds[:, j : j + 1]
                    sums = sums * w.share[j] + more
            out[:, w.features[i]] += w.value * (holds[:, i] - w.share[i]) * (sums @ weight)
    return out, mean


def shapley_values(rows: DataFrame, model: GBTRegressionModel, features: tuple[str, ...], key: str) -> DataFrame:
    """Per row: key, one Shapley value per feature, and base, the mean prediction. Missing values count as 0, as in training."""
    ways = model_ways(model, rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values, mean = shapley(ways, b[list(features)].to_numpy(dtype=float))
            out = pd.DataFrame(values, columns=list(features))
            out.insert(0, key, b[key].to_numpy())
            yield out.assign(base=mean)

    kinds = dict(rows.dtypes)
    plain = rows.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    return plain.mapInPandas(run, f"`{key}` {kinds[key]}, " + ", ".join(f"`{c}` double" for c in features) + ", base double")


def importance(values: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Per feature: the mean size of its Shapley values, and their mean."""
    each = values.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in features])).alias("x"))
    return each.groupBy("x.feature").agg(F.avg(F.abs("x.v")).alias("importance"), F.avg("x.v").alias("mean"))
