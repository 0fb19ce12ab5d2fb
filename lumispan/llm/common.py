"""Helpers that the operators share: tables, shared storage, distributed running totals."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: White space between words: the bytes 0x20 and 0x09 to 0x0D, and nothing else.
SPACES = " \t\n\x0b\f\r"
#: A word, as a regular expression that Java and RE2 read alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where the cluster names one; a temporary folder only where it is
    unset and the master is local, as in tests on one machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("LUMISPAN_SCRATCH")
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = os.environ["LUMISPAN_SCRATCH"] = tempfile.mkdtemp(prefix="lumispan-")
    return path.rstrip("/")


def written(df: DataFrame, name: str, batch: int = 1000) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends there and
    a lost executor costs no recomputation. The folder is unique, so reruns never meet. Meanwhile
    Python is handed ``batch`` rows at a time: texts and shingle sets are large."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(batch, int(before)) if int(before) > 0 else batch)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def worker_memo(name: str) -> dict:
    """A dict that lives across the tasks of this Python worker, until another name is asked for: one
    operator's memo never takes the memory of the next, and what the last one held goes back to the system."""
    home = sys.modules.setdefault("_lumispan_worker", types.ModuleType("_lumispan_worker"))
    if home.__dict__.get("owner") != name:
        home.__dict__.update(owner=name, memo={})
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)
    return home.__dict__["memo"]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_draw(*parts: Column | str, digits: int = 12) -> Column:
    """A number in (0, 1) from the md5 of the parts, the same in every engine that has md5."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    top = F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")
    return (top.cast("double") + 0.5) / float(16**digits)


def spread(column: Column, buckets: int) -> Column:
    """A bucket from 0 to ``buckets`` - 1 from the md5 of ``column``; null has one of its own draws."""
    text = F.coalesce(column.cast("string"), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def running_total(
    df: DataFrame, groups: list[str], bucket: str, order: list[str], value: Column, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its group.

    Rows are ordered by ``bucket``, then by ``order``. A group can hold any share of all rows:
    only the rows of one (group, bucket) meet in a task, and the totals of the buckets before
    come from a small table with a row per (group, bucket). Rows that agree in every order
    column get consecutive places in an arbitrary order.
    """
    keys = [*groups, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*groups).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        df.join(base, condition, "left")
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_base", *[f"_k{i}" for i in range(len(keys))])
    )
