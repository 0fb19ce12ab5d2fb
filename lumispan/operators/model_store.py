"""An append-only store of a growing model.

A version holds what its traces add: the features that no version before knew, numbered on from the vocabulary's end,
and the state of its traces with features by their numbers. What a reader at version v lacks of version w is the
vocabulary beyond its size and the tables of the versions between. The model at a version is the sum of all up to it, so
base and deltas give what training on all traces would; ``compacted`` folds a prefix of versions into one.

A version counts once its marker is written, which comes last: a lost writer leaves a version that nobody reads and the
next writer passes over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import stored
from ..schema import ModelConfig
from .model import MEMORISED, PAIR_KEY, Model, node_vocabulary
from .model_state import ModelState, added, pair_totals, state_names
from .numbering import numbered

#: Columns of state tables that hold a feature; ``parent`` is '' above a root.
NAMED = ("feature", "parent")


@dataclass(frozen=True)
class ModelStore:
    spark: SparkSession
    path: str
    config: ModelConfig

    def _folder(self, version: int) -> str:
        return f"{self.path}/version={version:08d}"

    def _entries(self) -> list[tuple[int, bool]]:
        """The numbers of all versions that were begun, and whether each is whole."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        found = sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))
        return [(v, fs.exists(hadoop.Path(f"{self._folder(v)}/done/_SUCCESS"))) for v in found]

    def versions(self) -> list[int]:
        return [v for v, whole in self._entries() if whole]

    def _read(self, version: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder(version)}/{name}")

    def base(self, upto: int | None = None) -> int:
        """The first version that a reader of ``upto`` needs: the last one that stands for all before it."""
        known = [v for v in self.versions() if upto is None or v <= upto]
        if not known:
            return -1
        starts = self.spark.read.parquet(*[f"{self._folder(v)}/done" for v in known]).where("is_base").agg(F.max("version").alias("v")).first()["v"]
        return known[0] if starts is None else int(starts)

    def needed(self, upto: int | None = None) -> list[int]:
        base = self.base(upto)
        return [v for v in self.versions() if v >= base and (upto is None or v <= upto)]

    def vocabulary(self, upto: int | None = None, beyond: int = 0) -> DataFrame:
        """Features and their numbers up to a version; with ``beyond``, those that a reader of so many lacks."""
        parts = self.needed(upto)
        if not parts:
            return self.spark.createDataFrame([], "feature string, node_idx bigint")
        rows = self.spark.read.parquet(*[f"{self._folder(v)}/vocabulary" for v in parts])
        return rows.where(F.col("node_idx") >= beyond)

    def size(self, upto: int | None = None) -> int:
        return self.vocabulary(upto).count()

    def _write(self, version: int, tables: dict[str, DataFrame], vocabulary: DataFrame, is_base: bool) -> int:
        vocabulary.write.parquet(f"{self._folder(version)}/vocabulary")
        for name, t in tables.items():
            t.write.parquet(f"{self._folder(version)}/{name}")
        mark = self.spark.range(1).select(F.lit(version).alias("version"), F.lit(is_base).alias("is_base"))
        mark.write.parquet(f"{self._folder(version)}/done")
        return version

    def _encoded(self, name: str, t: DataFrame, vocabulary: DataFrame) -> DataFrame:
        if name == "templates":
            nodes = t.select("bucket", "trace_type", "size", "n", F.monotonically_increasing_id().alias("_t"), "nodes")
            nodes = stored(nodes, "store_templates")
            each = nodes.select("_t", F.posexplode("nodes").alias("i", "x")).join(vocabulary.withColumnRenamed("feature", "_f"), F.col("x.feature") == F.col("_f"))
            each = each.groupBy("_t").agg(F.array_sort(F.collect_list(F.struct("i", "x.depth", "node_idx", "x.child_count"))).alias("nodes"))
            return nodes.drop("nodes").join(each, "_t").drop("_t")
        for c in (c for c in NAMED if c in t.columns):
            v = vocabulary.select(F.col("feature").alias("_f"), F.col("node_idx").alias("_i"))
            t = t.join(v, F.col(c) == F.col("_f"), "left").withColumn(c, F.coalesce("_i", F.lit(-1))).drop("_f", "_i")
        return t

    def _decoded(self, name: str, t: DataFrame, vocabulary: DataFrame) -> DataFrame:
        if name == "templates":
            nodes = stored(t.withColumn("_t", F.monotonically_increasing_id()), "store_templates")
            each = nodes.select("_t", F.explode("nodes").alias("x")).join(vocabulary, F.col("x.node_idx") == F.col("node_idx"))
            node = F.struct("x.i", F.struct("x.depth", "feature", "x.child_count").alias("node"))
            each = each.groupBy("_t").agg(F.transform(F.array_sort(F.collect_list(node)), lambda x: x["node"]).alias("nodes"))
            return nodes.drop("nodes").join(each, "_t").drop("_t")
        for c in (c for c in NAMED if c in t.columns):
            v = vocabulary.select(F.col("feature").alias("_f"), F.col("node_idx").alias("_i"))
            t = t.join(v, F.col(c) == F.col("_i"), "left").withColumn(c, F.coalesce("_f", F.lit(""))).drop("_f", "_i")
        return t

    def append(self, state: ModelState) -> int:
        """A version of what a state of new traces adds; returns its number."""
        if state.config != self.config:
            raise ValueError("the state's configuration isn't the store's")
        begun = self._entries()
        version = begun[-1][0] + 1 if begun else 0
        known = stored(self.vocabulary(), "store_vocabulary")
        new = state.vocabulary.select("feature").distinct().join(known, "feature", "left_anti")
        new = stored(numbered(new, ["feature"], "node_idx", known.count()).select("feature", "node_idx"), "store_vocabulary")
        both = known.unionByName(new)
        tables = {n: self._encoded(n, t, both) for n, t in state.tables.items()}
        return self._write(version, tables, new, not self.versions())

    def state(self, upto: int | None = None) -> ModelState:
        """The state of all traces up to a version, rebuilt from its base and what was added since."""
        parts = self.needed(upto)
        if not parts:
            raise ValueError(f"no version in {self.path}")
        vocabulary = stored(self.vocabulary(upto), "store_vocabulary")
        tables = {}
        for name in state_names(self.config):
            whole = added(name, [self._read(v, name) for v in parts])
            tables[name] = stored(self._decoded(name, whole, vocabulary), f"store_{name}")
        few = pair_totals(tables).where(F.col("_n") <= MEMORISED)
        tables["small_samples"] = stored(tables["small_samples"].join(few, list(PAIR_KEY), "left_semi"), "store_small_samples")
        own = tables["start"].select("bucket", "feature").unionByName(tables[self._topology()].select("bucket", self._features()).distinct())
        return ModelState(tables, stored(node_vocabulary(own), "store_bucket_vocabulary"), self.config)

    def _topology(self) -> str:
        return "edges" if self.config.topology_mode == "edge" else "templates"

    def _features(self):
        return F.col("feature") if self.config.topology_mode == "edge" else F.explode("nodes.feature").alias("feature")

    def model(self, upto: int | None = None) -> Model:
        return self.state(upto).finalised()

    def compacted(self) -> int:
        """A version that stands for all before it: readers that start anew begin there, others may read on."""
        parts = self.needed()
        version = self._entries()[-1][0] + 1
        tables = {n: added(n, [self._read(v, n) for v in parts]) for n in state_names(self.config)}
        return self._write(version, tables, self.vocabulary(), True)

    def delta(self, after: int) -> tuple[DataFrame, dict[str, DataFrame]]:
        """What a reader of version ``after`` lacks: the vocabulary beyond its own, and the tables of the versions since,
        features by number; all of it before the first. A version that only compacts adds nothing."""
        if after < 0:
            parts = self.needed()
            return self.vocabulary(), {n: added(n, [self._read(v, n) for v in parts]) for n in state_names(self.config)}
        later = [v for v in self.versions() if v > after]
        bases = {r["version"] for r in self.spark.read.parquet(*[f"{self._folder(v)}/done" for v in later]).where("is_base").collect()} if later else set()
        later = [v for v in later if v not in bases]
        tables = {n: added(n, [self._read(v, n) for v in later]) for n in state_names(self.config)} if later else {}
        return self.vocabulary(beyond=self.size(after)), tables
