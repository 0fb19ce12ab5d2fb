"""Training: the tables that describe a bucket of traces. Every table is a grouped aggregate per bucket. Counts, sums and
bounds can be merged (``model_state``); what is derived from them, shares, lines, percentiles and mixtures, is not."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.storage import stored
from ..schema import ModelConfig
from .tree import positioned, rooted, templates, with_parent

MEMORISED = 20
PERCENTILES = tuple(i / 20 for i in range(21))
#: The place of a child: what its feature and child count are drawn for.
SLOT = ("bucket", "trace_type", "parent", "parent_count", "position")
PAIR_KEY = ("bucket", "parent", "feature")


def annotated(spans: DataFrame) -> DataFrame:
    """Derived spans plus position, siblings, child_count and trace_type."""
    kind = F.when(F.col("error_trace"), "error").otherwise("normal")
    return positioned(spans).withColumn("trace_type", kind)


def node_vocabulary(spans: DataFrame) -> DataFrame:
    """Dense numbers of the features, in their order, per bucket."""
    f = spans.select("bucket", "feature").distinct()
    return f.withColumn("node_idx", F.dense_rank().over(W.partitionBy("bucket").orderBy("feature")) - 1)


def encoded(features: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add node_idx; unknown features are 0."""
    return features.join(vocabulary, ["bucket", "feature"], "left").withColumn("node_idx", F.coalesce("node_idx", F.lit(0)))


def extended(vocabulary: DataFrame, features: DataFrame) -> DataFrame:
    """A vocabulary with new features numbered after the old ones, which keep their numbers."""
    new = features.select("bucket", "feature").distinct().join(vocabulary, ["bucket", "feature"], "left_anti")
    most = vocabulary.groupBy("bucket").agg(F.max("node_idx").alias("_m"))
    rank = F.row_number().over(W.partitionBy("bucket").orderBy("feature"))
    new = new.join(most, "bucket", "left").select("bucket", "feature", (F.coalesce("_m", F.lit(-1)) + rank).alias("node_idx"))
    return vocabulary.unionByName(new)


def start_table(a: DataFrame) -> DataFrame:
    return a.where("is_root").groupBy("bucket", "trace_type", "feature", "child_count").agg(F.count(F.lit(1)).alias("n"))


def edges_of(a: DataFrame) -> DataFrame:
    """Resolved parent-child pairs; the parent's child count is of resolved children."""
    return with_parent(a.drop("p_span_id"), ["feature", "start_us", "dur_us"], "inner").withColumn("parent_count", F.col("siblings"))


def edge_counts(a: DataFrame) -> DataFrame:
    """How often a child feature stands at a position under a parent feature."""
    keys = ["bucket", "trace_type", F.col("p_feature").alias("parent"), "parent_count", "position"]
    return edges_of(a).groupBy(*keys, "feature", "child_count").agg(F.count(F.lit(1)).alias("n"))


def with_share(counts: DataFrame, *keys: str) -> DataFrame:
    """Add probability: n over the sum of n of the same keys."""
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(W.partitionBy(*keys)))


def topology_edges(a: DataFrame) -> DataFrame:
    """Edge counts with the probability of each child at its place."""
    return with_share(edge_counts(a), *SLOT)


def template_table(a: DataFrame) -> DataFrame:
    t = templates(a.drop("p_span_id", "position", "siblings", "normal_position", "child_count"))
    roots = a.where("is_root").select("trace_id", F.col("span_id").alias("root"), "bucket", "trace_type")
    return t.join(roots, ["trace_id", "root"]).groupBy("bucket", "trace_type", "nodes", "size").agg(F.count(F.lit(1)).alias("n"))


def duration_bounds(a: DataFrame) -> DataFrame:
    d = a.where("has_parent AND dur_us > 0")
    return d.groupBy("bucket", "feature").agg(F.min("dur_us").alias("lo"), F.max("dur_us").alias("hi"))


def gap_bounds(a: DataFrame) -> DataFrame:
    g = edges_of(a).withColumn("gap", F.col("start_us") - F.col("p_start_us")).where("gap >= 0")
    return g.groupBy("bucket", "feature").agg(F.min("gap").alias("lo"), F.max("gap").alias("hi"))


def bucket_meta(a: DataFrame) -> DataFrame:
    """First and last trace start, traces, spans of the largest tree."""
    size = rooted(a).groupBy("trace_id", "root").agg(F.count(F.lit(1)).alias("s")).groupBy("trace_id").agg(F.max("s").alias("s"))
    per = a.groupBy("trace_id", "bucket").agg(F.min("start_us").alias("t")).join(size, "trace_id")
    return per.groupBy("bucket").agg(
        F.min("t").alias("first_us"), F.max("t").alias("last_us"), F.count(F.lit(1)).alias("traces"), F.max("s").alias("max_tree")
    )


def gaussian_mixture(
    x: np.ndarray, k: int, rounds: int = 100, tolerance: float = 1e-6, count: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and variances of a one-dimensional mixture by expectation maximisation; ``count`` says how often
    each value occurs."""
    c = np.ones(len(x)) if count is None else np.asarray(count, dtype=float)
    order = np.argsort(x, kind="stable")
    x, c = np.asarray(x, dtype=float)[order], c[order]
    n = int(c.sum())
    k = max(1, min(k, n))
    means = x[np.searchsorted(np.cumsum(c), [(i * n + n // 2) // k for i in range(k)], side="right")].copy()
    mean = (c * x).sum() / n
    weights, variances = np.full(k, 1.0 / k), np.full(k, max((c * (x - mean) ** 2).sum() / n, 1e-10))
    before = -np.inf
    for _ in range(rounds):
        log = np.log(weights) - 0.5 * np.log(2 * np.pi * variances) - 0.5 * (x[:, None] - means) ** 2 / variances
        top = log.max(axis=1, keepdims=True)
        each = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
        total = (c * each).sum()
        if abs(total - before) < tolerance:
            break
        before = total
        share = np.exp(log - each[:, None]) * c[:, None]
        mass = share.sum(axis=0)
        live = mass >= 1e-10
        weights = np.where(live, mass / n, weights)
        safe = np.where(live, mass, 1.0)
        means = np.where(live, (share * x[:, None]).sum(axis=0) / safe, means)
        variances = np.where(live, np.maximum((share * (x[:, None] - means) ** 2).sum(axis=0) / safe, 1e-6), variances)
    return weights, means, variances


def root_duration_stats(a: DataFrame) -> DataFrame:
    """What the mixtures start from: n, bounds, and mean and population variance of log(duration + 1)."""
    y = F.log1p(F.col("dur_us").cast("double"))
    return a.where("is_root").groupBy("bucket", "feature", "child_count").agg(
        F.count(F.lit(1)).alias("n"), F.min("dur_us").alias("lo"), F.max("dur_us").alias("hi"), F.avg(y).alias("mean"),
        F.greatest(F.var_pop(y), F.lit(1e-6)).alias("variance"),
    )


ROOT = ("bucket", "feature", "child_count")
FITTED = "bucket bigint, feature string, child_count bigint, n bigint, lo bigint, hi bigint, weights array<double>, means array<double>, variances array<double>"


def root_counts(a: DataFrame) -> DataFrame:
    """Roots per bucket, feature, child count and duration."""
    return a.where("is_root").groupBy(*ROOT, "dur_us").agg(F.count(F.lit(1)).alias("c"))


def root_durations(a: DataFrame, config: ModelConfig, distinct: int = 10_000) -> DataFrame:
    """Mixtures of log(root duration + 1) per bucket, feature and child count, each fitted on all roots."""
    return mixtures(stored(root_counts(a), "root_counts"), config, distinct)


def _fit_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Many groups an Arrow batch: each row is a group with its durations and their counts."""
    for batch in batches:
        fits = []
        for values, times, k in zip(batch["values"], batch["times"], batch["k"], strict=True):
            w, m, v = gaussian_mixture(np.log1p(np.asarray(values, dtype=float)), int(k), count=np.asarray(times))
            fits.append((w.tolist(), m.tolist(), np.maximum(v, 1e-6).tolist()))
        out = batch[[*ROOT, "n", "lo", "hi"]].copy()
        for i, name in enumerate(("weights", "means", "variances")):
            out[name] = [f[i] for f in fits]
        yield out


def mixtures(counts: DataFrame, config: ModelConfig, distinct: int = 10_000) -> DataFrame:
    """The mixtures of counts per duration. A group of one component is a mean and a variance, summed where it stands; the
    rest go through expectation maximisation: those of at most ``distinct`` durations many a batch, from one row each,
    and larger ones by the same rounds as grouped sums, so that none gathers in a task.
    """
    most = config.max_gmm_components
    x = F.log1p(F.col("dur_us").cast("double"))
    groups = counts.groupBy(*ROOT).agg(
        F.sum("c").alias("n"), F.min("dur_us").alias("lo"), F.max("dur_us").alias("hi"), F.count(F.lit(1)).alias("_d"),
        F.sum(F.col("c") * x).alias("_sx"), F.sum(F.col("c") * x * x).alias("_sxx"),
    )
    k = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("n") / 10))).cast("int")
    groups = stored(groups.withColumn("k", k), "root_groups")
    mean = F.col("_sx") / F.col("n")
    spread = F.greatest(F.col("_sxx") / F.col("n") - mean * mean, F.lit(1e-6))
    one = groups.where("k = 1").select(*ROOT, "n", "lo", "hi", F.array(F.lit(1.0)).alias("weights"), F.array(mean).alias("means"), F.array(spread).alias("variances"))
    several = groups.where((F.col("k") > 1) & (F.col("_d") <= distinct)).select(*ROOT, "n", "lo", "hi", "k")
    # The join spreads by duration as well; what is gathered after it has at most ``distinct`` values a row.
    gathered = counts.join(several, list(ROOT)).groupBy(*ROOT, "n", "lo", "hi", "k").agg(F.collect_list(F.struct("dur_us", "c")).alias("v"))
    gathered = gathered.select(*ROOT, "n", "lo", "hi", "k", F.col("v.dur_us").alias("values"), F.col("v.c").alias("times"))
    fitted = stored(gathered.mapInPandas(_fit_groups, FITTED), "mixtures", batch=64)
    large = groups.where((F.col("k") > 1) & (F.col("_d") > distinct)).select(*ROOT, "n", "lo", "hi", "k")
    out = one.unionByName(fitted)
    return out if large.isEmpty() else out.unionByName(wide_mixtures(counts, large))


def wide_mixtures(counts: DataFrame, groups: DataFrame, rounds: int = 100, tolerance: float = 1e-6, salts: int = 64) -> DataFrame:
    """The rounds of gaussian_mixture for groups of any size, over counts per duration: each round joins the values
    with the group's components and sums the responsibilities."""
    key = list(ROOT)
    x = F.log1p(F.col("dur_us").cast("double"))
    # Running counts in two steps: over whole ranges of sorted values, then within a range.
    values = counts.join(groups.select(*key), key, "left_semi").repartitionByRange(256, *key, "dur_us")
    values = stored(values.select(*key, "dur_us", "c", x.alias("x"), F.spark_partition_id().alias("part")), "root_values")
    whole = values.groupBy(*key, "part").agg(F.sum("c").alias("_s"))
    whole = whole.withColumn("_before", F.sum("_s").over(W.partitionBy(*key).orderBy("part")) - F.col("_s")).drop("_s")
    upto = F.sum("c").over(W.partitionBy(*key, "part").orderBy("dur_us"))
    ends = values.withColumn("_upto", upto).join(whole, [*key, "part"]).withColumn("_upto", F.col("_upto") + F.col("_before"))
    index = F.expr("transform(sequence(0, k - 1), j -> (j * n + n div 2) div k)")
    hits = F.filter("_index", lambda p: (p >= F.col("_upto") - F.col("c")) & (p < F.col("_upto")))
    starts = ends.join(groups.select(*key, index.alias("_index")), key).select(*key, "x", F.explode(hits).alias("_p"))
    starts = starts.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "x"))), lambda s: s["x"]).alias("means"))
    mean = values.groupBy(*key).agg((F.sum(F.col("c") * F.col("x")) / F.sum("c")).alias("_m"))
    salt = F.pmod(F.xxhash64("dur_us"), F.lit(salts)).alias("salt")
    each_salt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt")
    values = stored(values.select(*key, "x", "c", salt), "root_values")
    away = values.join(mean.select("*", each_salt), [*key, "salt"]).groupBy(*key).agg(
        (F.sum(F.col("c") * (F.col("x") - F.col("_m")) * (F.col("x") - F.col("_m"))) / F.sum("c")).alias("_v")
    )
    fit = groups.join(starts, key).join(away, key).select(
        *key, "n", "lo", "hi", F.transform(F.sequence(F.lit(1), "k"), lambda _: F.lit(1.0) / F.col("k")).alias("weights"), "means",
        F.transform(F.sequence(F.lit(1), "k"), lambda _: F.greatest("_v", F.lit(1e-10))).alias("variances"),
        F.lit(float("-inf")).alias("before"), F.lit(False).alias("done"),
    )
    fit = stored(fit, "mixtures")
    for _ in range(rounds):
        active = fit.where("NOT done")
        if active.isEmpty():
            break
        v = values.join(active.select(*key, "weights", "means", "variances", each_salt), [*key, "salt"])
        log = F.expr("transform(weights, (w, j) -> ln(w) - 0.5 * ln(2 * pi() * variances[j]) - 0.5 * (x - means[j]) * (x - means[j]) / variances[j])")
        v = v.select(*key, "x", "c", "means", log.alias("log")).withColumn("top", F.array_max("log"))
        v = v.withColumn("each", F.col("top") + F.log(F.aggregate("log", F.lit(0.0), lambda s, z: s + F.exp(z - F.col("top")))))
        v = v.select(*key, "x", "c", "means", "each", F.posexplode("log").alias("j", "z"))
        v = v.withColumn("share", F.exp(F.col("z") - F.col("each")) * F.col("c")).withColumn("d", F.col("x") - F.get("means", F.col("j")))
        sums = v.groupBy(*key, "j").agg(
            F.sum(F.col("c") * F.col("each")).alias("total"), F.sum("share").alias("mass"),
            F.sum(F.col("share") * F.col("d")).alias("s1"), F.sum(F.col("share") * F.col("d") * F.col("d")).alias("s2"),
        )
        sums = sums.groupBy(*key).agg(
            F.max(F.when(F.col("j") == 0, F.col("total"))).alias("total"), F.array_sort(F.collect_list(F.struct("j", "mass", "s1", "s2"))).alias("s")
        )
        live = "s[j].mass >= 1e-10"
        step = active.join(sums, key).withColumn("done", F.abs(F.col("total") - F.col("before")) < tolerance)
        step = step.select(
            *key, "n", "lo", "hi",
            F.expr(f"transform(weights, (w, j) -> IF(done OR NOT {live}, w, s[j].mass / n))").alias("weights"),
            F.expr(f"transform(means, (m, j) -> IF(done OR NOT {live}, m, m + s[j].s1 / s[j].mass))").alias("means"),
            F.expr(f"transform(variances, (v, j) -> IF(done OR NOT {live}, v, greatest(s[j].s2 / s[j].mass - pow(s[j].s1 / s[j].mass, 2), 1e-6)))").alias("variances"),
            F.col("total").alias("before"), "done",
        )
        fit = stored(fit.where("done").unionByName(step), "mixtures")
    return fit.select(*key, "n", "lo", "hi", "weights", "means", F.transform("variances", lambda z: F.greatest(z, F.lit(1e-6))).alias("variances"))


def pair_samples(a: DataFrame, config: ModelConfig) -> DataFrame:
    """Per span with a parent of positive duration: gap and duration relative to it; roots: 0 and 1."""
    e = edges_of(a).where("p_dur_us > 0")
    gap, dur = F.col("start_us") - F.col("p_start_us"), F.col("dur_us")
    if config.offset_value == "ratio":
        value = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / F.col("p_dur_us")))
    elif config.offset_model == "regression":
        value = lambda x: F.log1p(F.greatest(F.lit(0), x).cast("double"))
    else:
        value = lambda x: F.greatest(F.lit(0), x).cast("double")
    extra = [F.col("attrs").getItem(d).alias(d) for d in config.dependent]
    kids = e.select("bucket", F.col("p_feature").alias("parent"), "feature", F.col("normal_position").alias("x"), value(gap).alias("gap"), value(dur).alias("dur"), "span_id", *extra)
    roots = a.where("is_root").select("bucket", F.lit("").alias("parent"), "feature", F.lit(0.0).alias("x"), F.lit(0.0).alias("gap"), F.lit(1.0).alias("dur"), "span_id", *extra)
    return kids.unionByName(roots)


def pair_sums(samples: DataFrame) -> DataFrame:
    """What a line through the samples of a pair needs: sums over its positions, gaps and durations."""
    x, sums = F.col("x"), {}
    for y in ("gap", "dur"):
        sums |= {f"s_{y}": F.sum(y), f"sx_{y}": F.sum(x * F.col(y))}
    return samples.groupBy(*PAIR_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum(x * x).alias("sxx"), *[c.alias(k) for k, c in sums.items()]
    )


def lines(sums: DataFrame) -> DataFrame:
    """Least squares of gap and duration on the position per pair; the mean where n < 5 or positions don't vary."""
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    flat = (F.col("n") < 5) | (F.abs(det) < 1e-9)
    out = []
    for y in ("gap", "dur"):
        slope = F.when(flat, 0.0).otherwise((F.col("n") * F.col(f"sx_{y}") - F.col("sx") * F.col(f"s_{y}")) / det)
        out += [((F.col(f"s_{y}") - slope * F.col("sx")) / F.col("n")).alias(f"{y}_beta0"), slope.alias(f"{y}_beta1")]
    return sums.select(*PAIR_KEY, "n", *out)


def pair_regression(samples: DataFrame) -> DataFrame:
    return lines(pair_sums(samples))


def pair_values(samples: DataFrame) -> DataFrame:
    """How often each gap and each duration occurs per pair: y ('gap' or 'dur'), value, n."""
    y = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.col(y).alias("value")) for y in ("gap", "dur")])).alias("s")
    return samples.select(*PAIR_KEY, y).groupBy(*PAIR_KEY, "s.y", "s.value").agg(F.count(F.lit(1)).alias("n"))


def percentiles(values: DataFrame) -> DataFrame:
    """The percentiles of counted values per pair."""
    p = F.array(*[F.lit(x) for x in PERCENTILES])
    of = lambda y: F.percentile("value", p, F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"{y}_p")
    n = F.sum(F.when(F.col("y") == "gap", F.col("n")).otherwise(0)).alias("n")
    return values.groupBy(*PAIR_KEY).agg(n, of("gap"), of("dur"))


def pair_percentiles(samples: DataFrame) -> DataFrame:
    return percentiles(pair_values(samples))


def small_samples(samples: DataFrame) -> DataFrame:
    """Gap and duration of the samples of pairs that have at most 20, with how often each occurs."""
    n = samples.groupBy(*PAIR_KEY).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= MEMORISED).drop("_n")
    return samples.join(n, list(PAIR_KEY), "left_semi").groupBy(*PAIR_KEY, "gap", "dur").agg(F.count(F.lit(1)).alias("n"))


def memorised(small: DataFrame) -> DataFrame:
    """Raw gap and duration of counted samples, numbered in order; 20 at most a pair."""
    pair = W.partitionBy(*PAIR_KEY)
    rows = small.withColumn("_all", F.sum("n").over(pair))
    rows = rows.select(*PAIR_KEY, F.col("_all").alias("n"), "gap", "dur", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("_"))
    return rows.select(*PAIR_KEY, "n", (F.row_number().over(pair.orderBy("gap", "dur")) - 1).alias("i"), "gap", "dur")


def pair_memorised(samples: DataFrame) -> DataFrame:
    return memorised(small_samples(samples))


def attribute_counts(samples: DataFrame, attribute: str) -> DataFrame:
    """How often each value of a dependent attribute occurs per pair."""
    return samples.where(F.coalesce(attribute, F.lit("")) != "").groupBy(*PAIR_KEY, F.col(attribute).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def attribute_shares(samples: DataFrame, attribute: str) -> DataFrame:
    """Share of each value of a dependent attribute per pair."""
    return with_share(attribute_counts(samples, attribute), *PAIR_KEY)


@dataclass
class Model:
    """The tables of a model, by name."""

    tables: dict[str, DataFrame]
    config: ModelConfig

    def save(self, path: str) -> None:
        for name, t in self.tables.items():
            t.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark, path: str, config: ModelConfig) -> "Model":
        names = table_names(config)
        return Model({n: spark.read.parquet(f"{path}/{n}") for n in names}, config)

    def sizes(self) -> DataFrame:
        """Rows and bytes of each table as JSON lines, before and after gzip."""
        out = None
        for name, t in self.tables.items():
            j = t.select(F.to_json(F.struct("*")).alias("j"))
            one = j.mapInPandas(_packed_size, "rows bigint, raw bigint, gz bigint").agg(
                F.sum("rows").alias("rows"), F.sum("raw").alias("raw_bytes"), F.sum("gz").alias("gz_bytes")
            )
            one = one.select(F.lit(name).alias("field"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("rows", "raw_bytes", "gz_bytes")])
            out = one if out is None else out.unionByName(one)
        return out


def _packed_size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zlib

    z, raw, size, rows = zlib.compressobj(9, zlib.DEFLATED, 31), 0, 0, 0
    for b in batches:
        for line in b["j"]:
            data = line.encode() + b"\n"
            raw, size, rows = raw + len(data), size + len(z.compress(data)), rows + 1
    if rows:
        yield pd.DataFrame({"rows": [rows], "raw": [raw], "gz": [size + len(z.flush())]})


def table_names(config: ModelConfig) -> list[str]:
    names = ["vocabulary", "start", "edges" if config.topology_mode == "edge" else "templates", "root_durations"]
    names += ["duration_bounds", "gap_bounds", "pair_regression" if config.offset_model == "regression" else "pair_percentiles"]
    return [*names, "pair_memorised", "bucket_meta", *[f"attribute_{d}" for d in config.dependent]]


def train(spans: DataFrame, config: ModelConfig) -> Model:
    """All tables of the model of derived spans, stored: what is trained once is read by every level of generation."""
    from .model_state import state_of

    return state_of(spans, config).finalised()
