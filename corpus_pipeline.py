"""A training corpus from raw documents: toxicity, near copies, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on every row it is given and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage's rows to the shared folder and reads
them back, so a lost executor never reruns an earlier stage.

Edge cases: null texts count as empty throughout; repeated rows are kept apart up to near copies, which
keeps one row of a class, the one with the least id (of equal ids and texts any), and the row without an id only where its
whole class has none; texts that aren't alike stay, even where their ids are the same; very long texts go through every
stage whole and are cut into pieces by the last; an empty table gives empty stages; extra columns are dropped by the first stage that runs, whatever they
are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumispan.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"

#: No stage but the mix can be said in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def documents_of(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below 0.3. The model learns from the labels beside the documents."""
    from lumispan.llm.toxicity import fit, scored_rows

    model = fit(docs, table(spark, sf_dir, "labels"))
    return documents_of(scored_rows(docs.select(*COLUMNS), model).where("score < 0.3"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id."""
    from lumispan.llm.near_dedup import near_duplicates

    docs = documents_of(docs)
    first = near_duplicates(docs).where("is_first").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    rows = docs.withColumn("_text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    one = W.partitionBy("doc_id", "_text_hash").orderBy("text", "source", "lang", "n_chars")
    return documents_of(rows.withColumn("_n", F.row_number().over(one)).where("_n = 1"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes that 200-byte strings found elsewhere cover. A character that a
    cut would halve goes whole; a document without a word left goes."""
    from lumispan.llm.repeats import without_repeats

    rows = without_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(
        F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    )
    rows = rows.withColumn("text", text).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("bigint"))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return documents_of(rows.where(~F.coalesce(emptied, F.lit(False))))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, once per turn that the mix takes them; where a source's
    demand ends inside a document, that turn holds its first words only."""
    from lumispan.llm.source_mix import training_order

    rows = training_order(docs.select(*COLUMNS))
    return documents_of(rows.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("bigint")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences of 2048 tokens."""
    import public_tokenizers

    from lumispan.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path(TOKENIZER), CAPACITY)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_copies),
    ("repeats", repeated_passages),
    ("source_mix", source_mix),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
