"""Consecutive numbers in sorted order, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.storage import stored


def numbered(rows: DataFrame, order: list[str], out: str, first: int = 0) -> DataFrame:
    """Add ``out``: the place of each row in the order of the columns ``order``, from ``first``.

    Rows are dealt by range and numbered within their range; what comes before a range is a running sum over a table of
    a row per range. Rows that agree in every order column get neighbouring numbers.
    """
    dealt = rows.repartitionByRange(*order)
    dealt = stored(dealt.withColumn("_range", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as there are ranges
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    place = (F.col("_before") + inside - 1 + first).cast("bigint")
    return dealt.join(F.broadcast(sizes), "_range").withColumn(out, place).drop("_range", "_before")
