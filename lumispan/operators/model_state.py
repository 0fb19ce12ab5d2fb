"""A model in the making: counts, sums and bounds that merge, so that a window of traces can be trained in parts.

States of different traces are merged by adding what they count; a model is derived from a state at any time. Merging
the states of two halves gives the model of the whole: nothing that training needs is lost before ``finalised``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import stored
from ..schema import ModelConfig
from . import model as m

#: Per state table: its keys, and how each value of two states becomes one.
RULES: dict[str, tuple[tuple[str, ...], dict[str, str]]] = {
    "start": (("bucket", "trace_type", "feature", "child_count"), {"n": "sum"}),
    "edges": ((*m.SLOT, "feature", "child_count"), {"n": "sum"}),
    "templates": (("bucket", "trace_type", "nodes", "size"), {"n": "sum"}),
    "root_counts": ((*m.ROOT, "dur_us"), {"c": "sum"}),
    "duration_bounds": (("bucket", "feature"), {"lo": "min", "hi": "max"}),
    "gap_bounds": (("bucket", "feature"), {"lo": "min", "hi": "max"}),
    "pair_sums": (m.PAIR_KEY, dict.fromkeys(("n", "sx", "sxx", "s_gap", "sx_gap", "s_dur", "sx_dur"), "sum")),
    "pair_values": ((*m.PAIR_KEY, "y", "value"), {"n": "sum"}),
    "small_samples": ((*m.PAIR_KEY, "gap", "dur"), {"n": "sum"}),
    "bucket_meta": (("bucket",), {"first_us": "min", "last_us": "max", "traces": "sum", "max_tree": "max"}),
}
ATTRIBUTE: tuple[tuple[str, ...], dict[str, str]] = ((*m.PAIR_KEY, "value"), {"n": "sum"})


def rule_of(name: str) -> tuple[tuple[str, ...], dict[str, str]]:
    return RULES.get(name, ATTRIBUTE)


def state_names(config: ModelConfig) -> list[str]:
    names = ["start", "edges" if config.topology_mode == "edge" else "templates", "root_counts", "duration_bounds", "gap_bounds"]
    names += ["pair_sums" if config.offset_model == "regression" else "pair_values", "small_samples", "bucket_meta"]
    return [*names, *[f"attribute_{d}" for d in config.dependent]]


def pair_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """Samples per pair, from the table that every pair is in."""
    if "pair_sums" in tables:
        return tables["pair_sums"].select(*m.PAIR_KEY, F.col("n").alias("_n"))
    return tables["pair_values"].where("y = 'gap'").groupBy(*m.PAIR_KEY).agg(F.sum("n").alias("_n"))


def added(name: str, parts: list[DataFrame]) -> DataFrame:
    """One table of a state from those of several states."""
    keys, values = rule_of(name)
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    rows = reduce(DataFrame.unionByName, parts)
    kinds = dict(parts[0].dtypes)
    return rows.groupBy(*keys).agg(*[how[h](v).cast(kinds[v]).alias(v) for v, h in values.items()])


@dataclass
class ModelState:
    """The tables of a state by name, and the vocabulary that numbers its features per bucket."""

    tables: dict[str, DataFrame]
    vocabulary: DataFrame
    config: ModelConfig

    def merged(self, *others: "ModelState") -> "ModelState":
        """The state of the traces of all states, which must have none in common. Features keep the numbers that this
        state gave them; those that only others know are numbered after them."""
        states = [self, *others]
        if any(s.config != self.config for s in others):
            raise ValueError("states to merge must have one configuration")
        tables = {n: stored(added(n, [s.tables[n] for s in states]), f"merged_{n}") for n in state_names(self.config) if n != "small_samples"}
        # A pair that outgrew what is memorised lost its samples in one of the states already.
        few = pair_totals(tables).where(F.col("_n") <= m.MEMORISED)
        small = added("small_samples", [s.tables["small_samples"] for s in states])
        tables["small_samples"] = stored(small.join(few, list(m.PAIR_KEY), "left_semi"), "merged_small_samples")
        vocabulary = reduce(m.extended, [s.vocabulary for s in others], self.vocabulary)
        return ModelState(tables, stored(vocabulary, "merged_vocabulary"), self.config)

    def with_spans(self, spans: DataFrame) -> "ModelState":
        """This state and derived spans of further traces."""
        return self.merged(state_of(spans, self.config))

    def finalised(self) -> m.Model:
        t, c = self.tables, self.config
        build = {
            "vocabulary": lambda: self.vocabulary,
            "edges": lambda: m.with_share(t["edges"], *m.SLOT),
            "root_durations": lambda: m.mixtures(t["root_counts"], c),
            "pair_regression": lambda: m.lines(t["pair_sums"]),
            "pair_percentiles": lambda: m.percentiles(t["pair_values"]),
            "pair_memorised": lambda: m.memorised(t["small_samples"]),
        } | {f"attribute_{d}": (lambda d=d: m.with_share(t[f"attribute_{d}"], *m.PAIR_KEY)) for d in c.dependent}
        return m.Model({n: stored(build[n](), n) if n in build else t[n] for n in m.table_names(c)}, c)

    def save(self, path: str) -> None:
        for name, t in (self.tables | {"vocabulary": self.vocabulary}).items():
            t.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str, config: ModelConfig) -> "ModelState":
        tables = {n: spark.read.parquet(f"{path}/{n}") for n in state_names(config)}
        return ModelState(tables, spark.read.parquet(f"{path}/vocabulary"), config)


def state_of(spans: DataFrame, config: ModelConfig) -> ModelState:
    """The state of derived spans, stored."""
    a = stored(m.annotated(spans), "annotated")
    samples = stored(m.pair_samples(a, config), "pair_samples")
    build = {
        "start": lambda: m.start_table(a),
        "edges": lambda: m.edge_counts(a),
        "templates": lambda: m.template_table(a),
        "root_counts": lambda: m.root_counts(a),
        "duration_bounds": lambda: m.duration_bounds(a),
        "gap_bounds": lambda: m.gap_bounds(a),
        "pair_sums": lambda: m.pair_sums(samples),
        "pair_values": lambda: m.pair_values(samples),
        "small_samples": lambda: m.small_samples(samples),
        "bucket_meta": lambda: m.bucket_meta(a),
    } | {f"attribute_{d}": (lambda d=d: m.attribute_counts(samples, d)) for d in config.dependent}
    tables = {n: stored(build[n](), f"state_{n}") for n in state_names(config)}
    return ModelState(tables, stored(m.node_vocabulary(a), "state_vocabulary"), config)
