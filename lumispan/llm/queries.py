"""The queries that apply each operator to its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edit_probe

    return edit_probe(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mix import mixed

    wanted = ["doc_id", "size", "source_size", "target", "taken", "position_1", "position_2"]
    return mixed(table(spark, sf_dir, "documents")).select(*wanted)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_quality import line_quality

    return line_quality(table(spark, sf_dir, "documents"))


def op8_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard, uniform_tree, with_shard

    placed = shard(table(spark, sf_dir, "documents"), "doc_id", uniform_tree(24), with_shard(uniform_tree(24)))
    return placed.withColumn("law", F.lit("key"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import digest

    return digest(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import digest

    return digest(table(spark, sf_dir, "documents"))


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import judged

    return judged(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {
        "op1_html_text": op1_html_text,
        "op2_near_dedup": op2_near_dedup,
        "op3_fingerprints": op3_fingerprints,
        "op4_source_mix": op4_source_mix,
        "op5_token_counts": op5_token_counts,
        "op6_packing": op6_packing,
        "op7_line_quality": op7_line_quality,
        "op8_hash_tree": op8_hash_tree,
        "op9_toxicity": op9_toxicity,
        "op10_repeats": op10_repeats,
        "op11_vector_codes": op11_vector_codes,
        "op12_fill_middle": op12_fill_middle,
        "op13_url_rules": op13_url_rules,
    }


def oracle_sql() -> dict[str, str]:
    from . import sql

    return {
        "op4_source_mix": sql.SOURCE_MIX,
        "op7_line_quality": sql.LINE_QUALITY,
        "op8_hash_tree": sql.hash_tree(),
        "op11_vector_codes": sql.vector_codes(),
        "op12_fill_middle": sql.FILL_MIDDLE,
        "op13_url_rules": sql.URL_RULES,
    }
