"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, as in tests, one temporary folder of the
    process, on a local master only: the executors of a cluster would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("LUMISPAN_SCRATCH")
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.environ["LUMISPAN_SCRATCH"] = tempfile.mkdtemp(prefix="lumispan-")
    return base.rstrip("/")


def stored(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back, which ends its lineage: loops stay short and
    survive a lost executor. ``batch`` bounds the rows that Python is handed at a time meanwhile, where rows are large."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    if batch is not None:
        spark.conf.set(setting, batch)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)
