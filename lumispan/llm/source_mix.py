"""Mixing sources to target weights along a time-varying curriculum.

1. Targets: sources in code-point order weigh 5, 2, 1, repeating, and share 150 % of all words; a
   target stops at twice its source's size and the excess is shared again by weight. The fixed
   point is min(2 size, level * weight) for one common level, found from running sums over the
   sources ordered by 2 size / weight.
   The weight of a source is the integral of its schedule over training.
2. Schedule: a source's weight changes linearly over training time t in [0, 1], from (1 + tilt)
   to (1 - tilt) of its mean. Its integral is the source's cumulative demand
   D(t) = target * ((1 + tilt) t - tilt t^2).
3. Positions: a source's documents stand in the order of a hash; a document whose words start at
   cumulative count c in the source is due when D(t) = c, so its position is the root of a
   quadratic. The source is gone through once and, where the target exceeds its size, once more,
   to exactly the target D(1): the last document is taken up to the word where demand ends.
4. Order: occurrences are range-partitioned and sorted by position, with the texts that they take.

``training_order`` gives the mix, ``mixed`` what it takes of each document: that is read off the texts of the
mix in its order, so both go through all four steps.

Cumulative counts are sums of the buckets before, from a small table, and of the rows before in the bucket: a source
with a third of all rows is cut by hash. Texts are shuffled twice, with their bucket and into their place;
those of buckets that demand doesn't reach stay behind.

Edge cases: null text has size 0 and nothing is taken from it; the null source is the last one;
sources of size 0 have target 0; a very long text is one document, whose words are counted whole, and may be taken
in part; documents of one hash and size in a source, copies of a row, follow one another in any order and are taken alike;
equal or repeated doc_ids each keep their row, and each takes its own turns; an empty table gives no rows; extra columns
are dropped by ``mixed`` and kept by ``training_order``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, spread, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: The schedule's tilt of each weight: heavy sources lead, light ones come late.
TILTS = (0.5, 0.0, -0.5)
ORDER_BUCKETS = 1024


def source_targets(sizes: DataFrame, source: str = "source") -> DataFrame:
    """From a row per source with its ``source_size``: ``target`` and ``tilt``. One row per source,
    in one task; the table of sources is small beside the documents, whatever their number."""
    by_name = W.orderBy(F.col(source).asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("_turn") + 1)
    s = sizes.withColumn("_turn", turn).withColumn("_first", pick([w * (1 + x) for w, x in zip(WEIGHTS, TILTS, strict=True)]))
    s = s.withColumn("_last", pick([w * (1 - x) for w, x in zip(WEIGHTS, TILTS, strict=True)]))
    # The schedule runs from _first to _last, so its integral over training is their mean.
    s = s.withColumn("_w", (F.col("_first") + F.col("_last")) / 2.0)
    s = s.withColumn("tilt", (F.col("_first") - F.col("_last")) / (F.col("_first") + F.col("_last")))
    s = s.withColumn("_cap", MOST * F.col("source_size").cast("double"))
    by_ratio = W.orderBy((F.col("_cap") / F.col("_w")), F.col(source).asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    total = F.lit(SHARE) * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    s = s.withColumn("_level", level)
    fits = F.col("_level") <= F.col("_cap") / F.col("_w")
    # Capping a source that needn't be lowers the level, so the highest level that fits is the fixed point.
    s = s.withColumn("_common", F.max(F.when(fits, F.col("_level"))).over(everything))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_common") * F.col("_w"), F.col("_cap")))
    return s.select(source, "source_size", F.round(target, 6).alias("target"), "tilt")


def demand_at(t: float, target: Column, tilt: Column) -> Column:
    """The words that a source's schedule asks for up to time ``t``: its integral, scaled to the target."""
    return target * ((1.0 + tilt) * t - tilt * t * t)


def position_at(words: Column, target: Column, tilt: Column) -> Column:
    """The time t in [0, 1] when a source's cumulative demand reaches ``words``: ``demand_at`` inverted."""
    y = F.least(F.greatest(words.cast("double") / target, F.lit(0.0)), F.lit(1.0))
    a = 1.0 + tilt
    root = F.when(tilt == 0.0, y).otherwise(2.0 * y / (a + F.sqrt(F.greatest(a * a - 4.0 * tilt * y, F.lit(0.0)))))
    return F.when(target > 0.0, root)


def placed(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """A row per document: ``_doc`` (the row, null where demand doesn't reach its bucket), ``_key``, ``size``, ``source_size``,
    ``target``, ``tilt``, ``_start`` (words before it in its source), and ``_name``, ``_bucket``, ``_place``, which tell rows apart.
    Sources go by a ``_name`` that is never null, so that join and window share one shuffle of the texts."""
    name = F.coalesce(F.concat(F.lit("="), F.col("_source").cast("string")), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.col(key).alias("_key"),
        F.col(source).alias("_source"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint").alias("size"),
        spread(F.col(key), ORDER_BUCKETS).alias("_bucket"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("_hash"),
        F.xxhash64(F.col(text)).alias("_text"),
    )
    totals = written(rows.groupBy("_source", "_bucket").agg(F.sum("size").cast("bigint").alias("_sum")), "mix-sizes")
    sizes = totals.groupBy("_source").agg(F.sum("_sum").cast("bigint").alias("source_size"))
    targets = source_targets(sizes, "_source").select(name.alias("_of"), "source_size", "target", "tilt")
    before = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(name.alias("_name"), "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    base = base.join(targets, F.col("_name") == F.col("_of")).drop("_of")
    rows = rows.withColumn("_name", name).drop("_source").join(base, ["_name", "_bucket"])
    rows = rows.withColumn("_doc", F.when(F.col("_base") < F.col("target"), F.col("_doc")))
    inside = W.partitionBy("_name", "_bucket").orderBy("_hash", "size", "_text")
    earlier = F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_start", F.col("_base") + F.coalesce(earlier, F.lit(0))).withColumn("_place", F.row_number().over(inside))
    return rows.drop("_base", "_hash", "_text")


def in_order(rows: DataFrame, text: str, others: bool = False) -> DataFrame:
    """The mix of ``placed`` rows, range-sorted by position: a row per turn of a document that demand reaches by t = 1,
    with ``_turn`` (its number, ``taken`` words and ``position``) and ``_part``, its text up to the last taken word. With ``others``,
    documents that aren't taken come as well, before the mix, without a turn."""
    size, target, tilt = F.col("size"), F.col("target"), F.col("tilt")
    due = F.floor(demand_at(1.0, target, tilt))

    def turn(i: int) -> Column:
        at = F.col("_start") + (i - 1) * F.col("source_size")
        taken = F.greatest(F.lit(0).cast("bigint"), F.least(size, due - at))
        return F.struct(F.lit(i).alias("turn"), taken.alias("taken"), F.round(position_at(at, target, tilt), 6).alias("position"))

    turns = F.filter(F.array(*[turn(i) for i in range(1, MOST + 1)]), lambda x: x["taken"] > 0)
    rows = rows.withColumn("_turn", (F.explode_outer if others else F.explode)(turns))
    part = first_words(F.col(f"_doc.`{text}`"), size, F.col("_turn.taken"))
    rows = rows.withColumn("_part", F.when(F.col("_turn").isNotNull(), part))
    # Only the part travels, not the text that it is cut from.
    rows = rows.withColumn("_doc", F.col("_doc").dropFields(f"`{text}`")).withColumn("_position", F.col("_turn.position"))
    return rows.repartitionByRange("_position", "_key").sortWithinPartitions("_position", "_key")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document: size, source_size, target, taken (words of the mix, repeats counted), taken_1 and taken_2
    (by turn) and position_1 and position_2 (of its turns; null where it isn't taken)."""
    mix = in_order(placed(docs.select(*dict.fromkeys([key, text, source])), key, text, source), text, others=True)
    words = F.regexp_count(F.coalesce("_part", F.lit("")), F.lit(WORD)).cast("bigint")
    row = ["_name", "_bucket", "_place"]
    kept = ["_key", "size", "source_size", "target"]
    mix = written(mix.select(*row, *kept, "_turn.turn", "_turn.position", words.alias("words")), "mix-order")
    turns = range(1, MOST + 1)
    out = mix.groupBy(*row).agg(
        *[F.first(c).alias(c) for c in kept],
        *[F.coalesce(F.max(F.when(F.col("turn") == i, F.col("words"))), F.lit(0).cast("bigint")).alias(f"taken_{i}") for i in turns],
        *[F.max(F.when(F.col("turn") == i, F.col("position"))).alias(f"position_{i}") for i in turns],
    )
    return out.select(
        F.col("_key").alias(key),
        "size",
        "source_size",
        "target",
        sum((F.col(f"taken_{i}") for i in turns), F.lit(0).cast("bigint")).alias("taken"),
        *[f"taken_{i}" for i in turns],
        *[f"position_{i}" for i in turns],
    )


def training_order(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs`` that it takes, once per turn, range-sorted by position.

    Adds ``turn`` and ``position`` in place of columns of these names; a document that demand takes in part is cut after its last
    taken word. Copies of a row each take their own turns.
    """
    mix = in_order(placed(docs, key, text, source), text)
    kept = [F.col("_part" if c == text else f"_doc.`{c}`").alias(c) for c in docs.columns if c not in ("turn", "position")]
    return mix.select(*kept, "_turn.turn", "_turn.position")


def first_words(text: Column, size: Column, taken: Column) -> Column:
    """``text`` up to its ``taken``-th word; whole where all ``size`` words are taken."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.when(taken >= size, text).otherwise(F.array_join(F.slice(pieces, 1, taken.cast("int")), ""))
