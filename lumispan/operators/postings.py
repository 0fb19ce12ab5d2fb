"""An index from column:value entries to the spans that have them, which answers any number of group keys in one plan.

Spans are numbered in the order of their ids; an entry's spans are kept per block of 32,768 numbers, as a sorted list of
places where they are few and as a bitmap where they are many. A key of several entries is the intersection of their
postings, block by block: a key meets the postings of its entries by one join and one grouping, whose groups are as
large as the key has entries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import PAIR, span_entries
from ..plans.storage import stored
from ..schema import PRIMARY
from .numbering import numbered

BLOCK = 32_768
#: A posting of more places than this is a bitmap of 4 KB.
FEW = 512


def _has(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(place, F.lit(8)))), F.lit(2)) == 1


@dataclass
class Postings:
    """numbers: trace_id, span_id, number; postings: entry, block, places (or null), bits (or null)."""

    numbers: DataFrame
    postings: DataFrame

    def save(self, path: str) -> None:
        self.numbers.write.mode("overwrite").parquet(f"{path}/numbers")
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Postings":
        return Postings(spark.read.parquet(f"{path}/numbers"), spark.read.parquet(f"{path}/postings"))

    def _met(self, keys: DataFrame) -> DataFrame:
        """Per key and block where every entry of the key occurs: places (or null) and bits (or null), one of them set."""
        wanted = keys.select("group_key").distinct().where("group_key <> 'all'")
        wanted = wanted.withColumn("_e", F.array_distinct(F.split("group_key", PAIR))).withColumn("_m", F.size("_e"))
        met = wanted.select("group_key", "_m", F.explode("_e").alias("entry")).join(self.postings, "entry")
        met = met.groupBy("group_key", "block", "_m").agg(
            F.count(F.lit(1)).alias("_n"), F.collect_list("places").alias("_lists"), F.bitmap_and_agg("bits").alias("_bits"), F.count("bits").alias("_dense")
        ).where("_n = _m")
        first = F.get("_lists", F.lit(0))
        few = F.aggregate(F.slice("_lists", 2, BLOCK), first, lambda a, b: F.array_intersect(a, b))
        few = F.filter(few, lambda p: (F.col("_dense") == 0) | _has(F.col("_bits"), p))
        return met.select(
            "group_key", "block", F.when(F.size("_lists") > 0, few).alias("places"), F.when(F.size("_lists") == 0, F.col("_bits")).alias("bits")
        )

    def counts(self, keys: DataFrame) -> DataFrame:
        """Per key of ``keys`` (group_key): n, its spans; 0 where it has none."""
        n = F.coalesce(F.size("places").cast("bigint"), F.bitmap_count("bits"))
        found = self._met(keys).groupBy("group_key").agg(F.sum(n).alias("n"))
        every = self.numbers.agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias("group_key"), "n")
        return keys.select("group_key").distinct().join(found.unionByName(every), "group_key", "left").select("group_key", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))

    def members(self, keys: DataFrame) -> DataFrame:
        """group_key, trace_id, span_id of every span that a key selects."""
        from_bits = F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda p: _has(F.col("bits"), p))
        rows = self._met(keys).select("group_key", "block", F.explode(F.coalesce("places", F.when(F.col("bits").isNotNull(), from_bits))).alias("place"))
        rows = rows.select("group_key", (F.col("block") * BLOCK + F.col("place")).alias("number")).join(self.numbers, "number")
        every = keys.select("group_key").distinct().where("group_key = 'all'").crossJoin(self.numbers)  # one row at most
        return rows.select("group_key", "trace_id", "span_id").unionByName(every.select("group_key", "trace_id", "span_id"))


def posting_index(spans: DataFrame, columns: tuple[str, ...] = PRIMARY, attributes: tuple[str, ...] | None = None, few: int = FEW) -> Postings:
    """The index of the entries of columns and attributes (None: all), stored."""
    entries = span_entries({c: F.col(c) for c in columns}, F.col("attrs"), attributes).alias("entries")
    rows = stored(numbered(spans.select("trace_id", "span_id", entries), ["trace_id", "span_id"], "number"), "numbered_spans")
    each = rows.select("number", F.explode("entries").alias("entry"))
    place = F.pmod("number", F.lit(BLOCK)).cast("int")
    packed = each.groupBy("entry", F.floor(F.col("number") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(place)).alias("places"))
    packed = stored(packed, "postings")
    sparse = packed.where(F.size("places") <= few).select("entry", "block", "places", F.lit(None).cast("binary").alias("bits"))
    dense = packed.where(F.size("places") > few).select("entry", "block", F.explode("places").alias("place")).groupBy("entry", "block")
    dense = dense.agg(F.bitmap_construct_agg("place").alias("bits")).select("entry", "block", F.lit(None).cast("array<int>").alias("places"), "bits")
    return Postings(rows.select("trace_id", "span_id", "number"), stored(sparse.unionByName(dense), "postings"))
