"""Draws from weighted values in constant expected time, one row a set of values and one row a draw.

The values of a key stand side by side in one row, with their running shares and a guide: as many cells of equal width
as there are values, each with the first value whose share reaches past the start of the cell. A draw looks at the
values between its cell's and the next one's, one or two on average, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def draw_table(weights: DataFrame, keys: list[str], values: list[str], weight: str, out: str = "_draw") -> DataFrame:
    """Per key: ``out``, a struct of upto (running shares), guide and value (structs of ``values``, in their order). Weights
    are integers, so shares don't depend on the order of sums."""
    key, order = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(*values)
    total, n = F.sum(weight).over(key), F.count(F.lit(1)).over(key)
    upto = F.sum(weight).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = weights.where(F.col(weight) > 0).select(
        *keys, F.struct(*values).alias("value"), (F.row_number().over(order) - 1).alias("i"), upto.alias("s"), (upto - F.col(weight)).alias("b"),
        total.alias("t"), n.alias("k"),
    )
    cells = (F.ceil(F.col("s") * F.col("k") / F.col("t")) - F.ceil(F.col("b") * F.col("k") / F.col("t"))).cast("int")
    entry = F.struct("i", (F.col("s") / F.col("t")).alias("upto"), cells.alias("cells"), "value")
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    guide = F.flatten(F.transform("e", lambda x: F.array_repeat(x["i"], x["cells"])))
    return packed.select(*keys, F.struct(F.col("e.upto").alias("upto"), guide.alias("guide"), F.col("e.value").alias("value")).alias(out))


def drawn(u: Column, table: str = "_draw") -> Column:
    """The value that ``u``, in (0, 1), falls on, as a struct; null where the table is null."""
    t = F.col(table)
    k = F.size(t["value"])
    cell = F.least(F.floor(u * k).cast("int"), k - 1)
    low = F.get(t["guide"], cell)
    high = F.coalesce(F.get(t["guide"], cell + 1), k - 1)
    passed = F.size(F.filter(F.slice(t["upto"], low + 1, high - low), lambda x: x <= u))
    return F.when(t.isNotNull(), F.get(t["value"], low + passed))
