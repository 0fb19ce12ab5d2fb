"""Mode-specific normalisation: a value as the mode of a mixture that it most likely came from, and its place in that mode.

Each column gets a variational Bayesian mixture of normal distributions whose weights are broken from a stick, so that
modes nobody needs fade. Values are counted first; a round of the fit joins counted values with the parameters, three
sums per mode and column come back, and the driver turns them into the next parameters: a few numbers a column, however
many rows there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored

MODES, ROUNDS, TOLERANCE, CONCENTRATION, RIDGE = 3, 100, 1e-3, 0.01, 1e-6


def digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function for positive numbers."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    while (small := x < 8).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


@dataclass(frozen=True)
class Fit:
    """A column's posterior: stick shares (a, b), precision and place of the means, degrees of freedom and variances."""

    a: np.ndarray
    b: np.ndarray
    precision: np.ndarray
    means: np.ndarray
    freedom: np.ndarray
    variances: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        v = self.a / (self.a + self.b)
        w = v * np.concatenate([[1.0], np.cumprod(1 - v)[:-1]])
        return w / w.sum()

    @property
    def stds(self) -> np.ndarray:
        return np.maximum(np.sqrt(self.variances), RIDGE)

    def constants(self) -> np.ndarray:
        """Per mode, what its log density has besides the squared distance."""
        whole = digamma(self.a + self.b)
        stick = digamma(self.a) - whole + np.concatenate([[0.0], np.cumsum(digamma(self.b) - whole)[:-1]])
        spread = np.log(2.0) + digamma(0.5 * self.freedom)
        return stick - 0.5 * np.log(2 * np.pi * self.variances) - 0.5 * np.log(self.freedom) + 0.5 * (spread - 1 / self.precision)


def posterior(mass: np.ndarray, first: np.ndarray, second: np.ndarray, prior: tuple[float, float], concentration: float = CONCENTRATION) -> Fit:
    """From per mode sums of responsibility, of value and of squared value, and the prior's mean and variance."""
    at, spread = prior
    n = mass + 10 * np.finfo(float).eps
    mean = first / n
    within = np.maximum(second / n - mean * mean, 0.0) + RIDGE
    precision, freedom = 1.0 + n, 1.0 + n
    after = np.concatenate([np.cumsum(n[::-1])[::-1][1:], [0.0]])
    variances = (spread + n * within + n / precision * (mean - at) ** 2) / freedom
    return Fit(1.0 + n, concentration + after, precision, (at + n * mean) / precision, freedom, variances)


def fitted(values: DataFrame, modes: int = MODES, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> dict[str, Fit]:
    """From (column, x): a fit per column. Modes start as ``modes`` equal shares of the rows in order of their values."""
    counts = stored(values.where("x is not null").groupBy("column", "x").agg(F.count(F.lit(1)).alias("c")), "value_counts")
    cuts = [i / modes for i in range(1, modes)]
    start = counts.groupBy("column").agg(
        F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("x")) / F.sum("c")).alias("mean"),
        F.percentile("x", F.array(*[F.lit(c) for c in cuts]), F.col("c")).alias("cuts") if cuts else F.array().cast("array<double>").alias("cuts"),
    )
    spread = counts.join(F.broadcast(start.select("column", "mean")), "column").groupBy("column")  # a row a column
    spread = spread.agg((F.sum(F.col("c") * (F.col("x") - F.col("mean")) ** 2) / F.greatest(F.sum("c") - 1, F.lit(1))).alias("spread"))
    known = {r["column"]: r for r in start.join(spread, "column").collect()}
    prior = {c: (r["mean"], max(r["spread"], RIDGE)) for c, r in known.items()}
    part = F.aggregate(F.col("cuts"), F.lit(0), lambda k, cut: k + (F.col("x") > cut).cast("int"))
    hard = counts.join(F.broadcast(start.select("column", "cuts")), "column").withColumn("part", part)
    hard = hard.select("column", "x", "c", *[(F.col("part") == k).cast("double").alias(f"r{k}") for k in range(modes)])
    fits = {c: posterior(*s, prior[c]) for c, s in _sums(hard, modes).items()}
    for _ in range(rounds):
        after = {c: posterior(*s, prior[c]) for c, s in _sums(_shared(counts, fits, modes), modes).items()}
        moved = max((float(np.abs(after[c].weights - fits[c].weights).max()) + float((np.abs(after[c].means - fits[c].means) / after[c].stds).max()) for c in fits), default=0.0)
        fits = after
        if moved < tolerance:
            break
    return fits


def _shared(counts: DataFrame, fits: dict[str, Fit], modes: int) -> DataFrame:
    """Counted values with the responsibility of each mode, r0 and on. The parameters are numbers in the expressions, and modes
    are columns, so that Spark compiles a round instead of walking arrays row by row."""

    def of(values) -> Column:
        out = F.lit(None).cast("double")
        for c, f in fits.items():
            out = F.when(F.col("column") == c, F.lit(float(values(f)))).otherwise(out)
        return out

    def log(k: int) -> Column:
        return of(lambda f: f.constants()[k]) - 0.5 * (F.col("x") - of(lambda f: f.means[k])) ** 2 / of(lambda f: f.variances[k])

    names = [f"l{k}" for k in range(modes)]
    rows = counts.where(F.col("column").isin(list(fits))).select("column", "x", "c", *[log(k).alias(n) for k, n in enumerate(names)])
    top = F.greatest(*names) if modes > 1 else F.col("l0")
    rows = rows.select("column", "x", "c", *names, top.alias("top"))
    rows = rows.select("column", "x", "c", *[F.exp(F.col(n) - F.col("top")).alias(f"e{k}") for k, n in enumerate(names)])
    total = sum((F.col(f"e{k}") for k in range(modes)), F.lit(0.0))
    return rows.select("column", "x", "c", *[(F.col(f"e{k}") / total).alias(f"r{k}") for k in range(modes)])


def _sums(rows: DataFrame, modes: int) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per column: for each mode the sums of responsibility, of value and of squared value."""
    power = (F.lit(1.0), F.col("x"), F.col("x") * F.col("x"))
    sums = [F.sum(F.col("c") * F.col(f"r{k}") * power[p]).alias(f"s{p}_{k}") for p in range(3) for k in range(modes)]
    return {r["column"]: tuple(np.array([r[f"s{p}_{k}"] for k in range(modes)]) for p in range(3)) for r in rows.groupBy("column").agg(*sums).collect()}


def _numbers(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def encoded(value: Column, fit: Fit) -> Column:
    """A struct of mode (the likeliest) and alpha: the distance from its mean in four deviations, held to -1 to 1."""
    weight = np.log(fit.weights + 1e-10) - np.log(fit.stds)
    score = F.transform(F.arrays_zip(_numbers(weight).alias("w"), _numbers(fit.means).alias("m"), _numbers(fit.stds).alias("s")), lambda p: p["w"] - 0.5 * ((value - p["m"]) / p["s"]) ** 2)
    mode = (F.array_position(score, F.array_max(score)) - 1).cast("int")
    alpha = (value - F.get(_numbers(fit.means), mode)) / (4.0 * F.get(_numbers(fit.stds), mode))
    return F.when(value.isNotNull(), F.struct(mode.alias("mode"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), alpha)).alias("alpha")))


def decoded(code: Column, fit: Fit) -> Column:
    return code["alpha"] * 4.0 * F.get(_numbers(fit.stds), code["mode"]) + F.get(_numbers(fit.means), code["mode"])


def normalised(rows: DataFrame, columns: dict[str, Column], key: list[str]) -> tuple[DataFrame, dict[str, Fit]]:
    """Keys and a code per column, and the fits that decode them."""
    values = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), c.cast("double").alias("x")) for n, c in columns.items()])).alias("v")).select("v.*")
    fits = fitted(values)
    return rows.select(*key, *[encoded(c.cast("double"), fits[n]).alias(n) for n, c in columns.items() if n in fits]), fits
