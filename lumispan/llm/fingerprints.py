"""Document fingerprints: bottom-k sketches of shingle hashes.

A shingle is five consecutive words (white-space separated; a text of fewer words is one shingle);
its hash is 48 bits of xxHash64 over the words' own xxHash64. A sketch is the k smallest distinct
hashes, in order. Sketches of parts merge into the sketch of the whole, and two of them estimate
resemblance, containment and the number of distinct shingles. Spark's own functions only.

Edge cases: null and empty texts have the empty sketch, alike (1) to each other and unlike (0)
anything else; the row after the last one is the first; with one row that is the row itself; rows
of equal key follow one another in order of their text; a null key comes first; an empty table
gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import let, written
from .line_quality import words_of

K = 128
WIDTH = 5
BITS = 48
#: Rows of neighbouring keys that one window task sorts together.
ROWS_PER_RANGE = 4000
#: Quantiles of the keys, within which ranges have equal widths.
QUANTILES = 256
#: Ranges (some 60 bytes each) up to which their first keys are broadcast; beyond that the join shuffles.
BROADCAST_RANGES = 200_000


def bottom(values: Column, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_distinct(values)), 1, k)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The sketch of a text, as an array of at most ``k`` increasing longs."""

    def from_hashes(h: Column) -> Column:
        short = F.slice(h, 1, F.least(F.size(h), F.lit(width)))
        whole = F.when(
            F.size(h) > 0, F.array(F.xxhash64(*[F.coalesce(F.get(short, i), F.lit(0).cast("bigint")) for i in range(width)]))
        ).otherwise(F.array().cast("array<bigint>"))
        many = F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, width)]),
        )
        hashes = F.when(F.size(h) < width, whole).otherwise(many)
        return bottom(F.transform(hashes, lambda x: F.shiftrightunsigned(x, 64 - BITS)), k)

    return let(F.transform(words_of(text), lambda w: F.xxhash64(w)), from_hashes)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what ``a`` and ``b`` are sketches of."""
    return bottom(F.concat(a, b), k)


def merged_over(df: DataFrame, groups: list[str], column: str, k: int = K) -> DataFrame:
    """One merged sketch per group, as ``column``. Values are deduplicated and ranked by grouped
    counts, so a group of any size never gathers in a task: only its k smallest values do."""
    values = df.select(*groups, F.explode(column).alias("_v")).distinct()
    slices = values.withColumn("_s", F.pmod(F.xxhash64("_v"), F.lit(64)))
    for keys in ([*groups, "_s"], groups):
        rank = F.row_number().over(W.partitionBy(*keys).orderBy("_v"))
        slices = slices.withColumn("_r", rank).where(F.col("_r") <= k)
    return slices.groupBy(*groups).agg(F.array_sort(F.collect_list("_v")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's k smallest hashes that both hold."""
    return let(
        merged(a, b, k),
        lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
            F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u).cast("double")
        ),
    )


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact while the sketch isn't full."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(
        F.lit(float(k - 1)) / ((F.element_at(a, k).cast("double") + 1.0) / float(1 << BITS))
    )


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds: the resemblance times the union's size over a's."""
    union = distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k))
    )


def as_text(a: Column) -> Column:
    """A sketch as lower-case hex, 12 digits a value."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), ""))


def with_next(df: DataFrame, key: str, tie: str, columns: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the row that follows in order of ``key`` (a number), then ``tie``; the first
    row follows the last.

    Keys are cut at their approximate quantiles, so that clusters of keys are spread, and between two quantiles
    into ranges of equal key width by the number of rows there. One task sorts a range, and each range gets a
    copy of the first key's rows of the range that follows, so no task sees more than its range. Rows of one key, or
    without one, stay together, as their order is that of their texts.
    """
    shares = F.array(*[F.lit(i / QUANTILES) for i in range(1, QUANTILES)])
    cuts = df.agg(F.array_distinct(F.coalesce(F.percentile_approx(key, shares, 4 * QUANTILES), F.array().cast("array<bigint>"))).alias("_cuts"))
    # Approximate quantiles depend on the order in which a shuffle's blocks arrive: they are taken once, for all that are placed by them.
    cuts = written(cuts, "cuts")
    part = F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(key)))).cast("bigint")
    keys = df.select(key).crossJoin(F.broadcast(cuts)).select(key, part.alias("_part"))  # one row: not a product
    parts = keys.groupBy("_part").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    n = F.greatest(F.lit(1), F.ceil(F.col("_n") / ROWS_PER_RANGE))
    width = F.coalesce(F.greatest(F.lit(1.0), F.ceil((F.col("_hi").cast("double") - F.col("_lo") + 1) / n)), F.lit(1.0))
    parts = written(parts.select(F.col("_part").alias("_p"), "_lo", width.alias("_width")), "parts")
    inside = F.coalesce(F.floor((F.col(key).cast("double") - F.col("_lo")) / F.col("_width")), F.lit(0)).cast("bigint")

    def placed(rows: DataFrame) -> DataFrame:
        """With _part and _range, a number that grows with the key. There are QUANTILES parts and one for nulls at most."""
        rows = rows.crossJoin(F.broadcast(cuts)).withColumn("_part", part).drop("_cuts")
        rows = rows.join(F.broadcast(parts), F.col("_part") == F.col("_p"))
        return rows.withColumn("_range", F.col("_part") * F.lit(1 << 40) + inside).drop("_lo", "_width", "_p")

    firsts = written(placed(df.select(key)).groupBy("_part", "_range").agg(F.min(key).alias("_first")), "ranges")
    heads, order = firsts.groupBy("_part").agg(F.min("_range").alias("_head")), W.orderBy("_part")
    heads = heads.select("_part", F.coalesce(F.lead("_head").over(order), F.first("_head").over(order)).alias("_head"))
    beside = F.lead("_range").over(W.partitionBy("_part").orderBy("_range"))
    following = firsts.join(F.broadcast(heads), "_part").select(F.col("_range").alias("_to"), F.coalesce(beside, "_head").alias("_from"))
    starts = firsts.select(F.col("_range").alias("_from"), F.col("_first"))
    guard_of = written(following.join(starts, "_from"), "guards")
    rows = placed(df).drop("_part")
    side = F.broadcast(guard_of) if guard_of.count() <= BROADCAST_RANGES else guard_of
    guards = (
        rows.join(side, (F.col("_range") == F.col("_from")) & F.col(key).eqNullSafe(F.col("_first")))
        .withColumn("_range", F.col("_to"))
        .drop("_from", "_first", "_to")
        .withColumn("_guard", F.lit(1))
    )
    both = rows.withColumn("_guard", F.lit(0)).unionByName(guards)
    window = W.partitionBy("_range").orderBy("_guard", F.col(key).asc_nulls_first(), tie)
    return (
        both.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns})
        .where(F.col("_guard") == 0)
        .drop("_guard", "_range")
    )


def edit_probe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of the text with its later half taken from the next document's
    start, and how alike the sketches are. Returns key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_shingles (estimated)."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_sketch", sketch(F.col("_text")))
    rows = with_next(rows, key, "_text", ["_text", "_sketch"])
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("next__text"), F.lit(1), half))
    rows = rows.select(key, n.cast("bigint").alias("n_chars"), "_sketch", "next__sketch", edited.alias("_edited"))
    rows = rows.withColumn("_edited_sketch", sketch(F.col("_edited")))
    return rows.select(
        key,
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        as_text(F.col("_sketch")).alias("fingerprint"),
        as_text(F.col("_edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("_sketch"), F.col("_edited_sketch")).alias("near_edited"),
        resemblance(F.col("_sketch"), F.col("next__sketch")).alias("near_next"),
        distinct_shingles(F.col("_sketch")).alias("n_shingles"),
    )
