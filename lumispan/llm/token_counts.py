"""Exact token counts by a length histogram.

Documents are counted by encoded length; suffix sums over the lengths then answer totals, quantiles
and the total that a context limit leaves, for every limit. Only the histogram (a row per distinct
length, whatever the number of documents) meets in a task. Edge cases: null and empty texts have
length 0; a very long text is encoded whole; texts of equal length, the only ties, are one row; repeated rows count each time; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .packing import RunEncoder


def lengths(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Per row: length, its tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = RunEncoder(tokenizer, 0)
        for batch in batches:
            yield pd.DataFrame({"length": [len(ids_of(t or "")) // 4 - 1 for t in batch[text]]})

    return docs.select(text).mapInPandas(run, "length bigint")


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Per distinct length: n_docs, n_longer (documents above it), total_tokens (of all documents up to it),
    truncated_total (tokens of all documents if each is cut to this length), quantile (share of documents up to it)."""
    counts = written(lengths(docs, tokenizer, text).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    upto = W.orderBy("length").rowsBetween(W.unboundedPreceding, W.currentRow)
    above = W.orderBy("length").rowsBetween(1, W.unboundedFollowing)
    rows = counts.select(
        "length",
        "n_docs",
        F.coalesce(F.sum("n_docs").over(above), F.lit(0)).cast("bigint").alias("n_longer"),
        F.sum(F.col("length") * F.col("n_docs")).over(upto).cast("bigint").alias("total_tokens"),
        F.sum("n_docs").over(upto).alias("_n"),
    )
    return rows.select(
        "length", "n_docs", "n_longer", "total_tokens",
        (F.col("total_tokens") + F.col("length") * F.col("n_longer")).alias("truncated_total"),
        (F.col("_n") / (F.col("_n") + F.col("n_longer"))).alias("quantile"),
    )
