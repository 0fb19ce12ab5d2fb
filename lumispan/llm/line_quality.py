"""Quality rules from each document's own words and from lines that many documents of a host share.

A line is normalised (lower case, one space between words, digits as 0) and hashed. Per host the
distinct document texts that hold it are counted; lines above the host's limit are removed, and a
document that loses more than a share of its words, or keeps too few, is rejected. All of it is
Spark's own functions; a document's lines are deduplicated before they are shuffled and counts are
summed on the map side, so a host or line with a third of all rows costs no more than others.

Edge cases: null text is a text without words (base_failed); a null host is a host of its own;
copies of one text count once for its lines; repeated doc_ids stay separate rows; very long texts
and lines are counted whole; no order is asked for, so nothing ties; an empty table gives no rows; extra columns are dropped, so clashing names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

SYMBOLS = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_word_count(words: Column, width: int = 5) -> Column:
    """Words in ``width``-word windows that the text holds twice or more, the first one included.

    Windows are compared by 64-bit hashes. Texts without a repeat, the common case, stop at one
    distinct count; the others sort their windows, keep those equal to a neighbour and add up how
    much each kept window covers that the next does not.
    """

    def from_hashes(h: Column) -> Column:
        windows = F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, width)]),
        )
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))

    def covered(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def flagged(p: Column) -> Column:
            again = F.filter(
                F.transform(
                    p,
                    lambda x, j: F.when(
                        F.coalesce(F.get(p, j + 1)["h"] == x["h"], F.lit(False))
                        | ((j > 0) & F.coalesce(F.get(p, F.greatest(j - 1, F.lit(0)))["h"] == x["h"], F.lit(False))),
                        x["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            return let(
                F.array_sort(again),
                lambda at: F.aggregate(
                    F.transform(at, lambda i, j: F.least(F.coalesce(F.get(at, j + 1) - i, F.lit(width)), F.lit(width))),
                    F.lit(0),
                    lambda a, b: a + b,
                ),
            )

        return let(pairs, flagged)

    return let(F.transform(words, lambda x: F.xxhash64(x)), from_hashes).cast("bigint")


def normal_line(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))), "[0-9]", "0")


def line_marks(text: Column) -> Column:
    """Per line with a word: h, the hash of its normal form, w, its words."""

    def mark(line: Column) -> Column:
        words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
        return F.struct(F.xxhash64(line).alias("h"), words.cast("int").alias("w"))

    return F.transform(with_word(text), lambda x: let(normal_line(x), mark))


def with_word(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def word_rules(words: Column) -> Column:
    """Struct of n_words, word_chars and n_repeat_words."""
    return let(
        words,
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeated_word_count(w).alias("n_repeat_words"),
        ),
    )


def line_quality(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_docs: int = 20,
    max_share: float = 0.002,
    max_removed: float = 0.6,
    min_words: int = 10,
    max_repeat_percent: int = 20,
) -> DataFrame:
    """Per document: the base rules, the words in lines that its host repeats, and the verdict.

    A line is above the limit where more than max(``max_docs``, ``max_share`` of the host's
    distinct texts) distinct texts of the host hold it. A document is depleted where such lines
    hold more than ``max_removed`` of its words. Returns key, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_shared_words (words in lines above the limit), base_failed, kept.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # Everything that a text decides, in one pass over the texts; what follows reads this narrow table.
    rows = docs.select(
        F.col(key),
        word_rules(words_of(F.col(text))).alias("_w"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        let(with_word(body), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("null")).alias("_host"),
        F.xxhash64(body).alias("_text"),
        line_marks(body).alias("_lines"),
    ).select("*", "_w.*").drop("_w")
    rows = written(rows, "quality-rules")
    # One row per distinct text of a host: copies fold into it before anything is exploded.
    once = rows.select("_host", "_text", "_lines").distinct()
    sizes = once.groupBy("_host").agg(F.count(F.lit(1)).alias("_texts"))
    held = (
        once.select("_host", F.explode(F.array_distinct(F.transform("_lines", lambda x: x["h"]))).alias("_line"))
        .groupBy("_host", "_line")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    above = (
        held.where(F.col("_n") > max_docs)
        .join(sizes, "_host")
        .where(F.col("_n") > max_share * F.col("_texts"))
        .select("_host", "_line")
    )
    shared = (
        once.select("_host", "_text", F.explode("_lines").alias("_l"))
        .select("_host", "_text", F.col("_l.h").alias("_line"), F.col("_l.w").alias("_w"))
        .join(above, ["_host", "_line"])
        .groupBy("_host", "_text")
        .agg(F.sum("_w").alias("n_shared_words"))
    )
    n, gone = F.col("n_words"), F.col("n_shared_words")
    failed = (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * n)
    return (
        rows.join(shared, ["_host", "_text"], "left")
        .withColumn("n_shared_words", F.coalesce(gone, F.lit(0)).cast("bigint"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (gone <= max_removed * n) & (n - gone >= min_words))
        .drop("_host", "_text", "_lines")
    )
