"""What steps take: rows, bytes and seconds of each, recorded as they run and joined to what the steps cost."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import cost_dollars
from ..plans.storage import shared_folder

TIMING = "step string, phase string, rows bigint, bytes bigint, seconds double"


@dataclass
class Timings:
    """A table of timing rows in the shared folder, one file a step."""

    spark: SparkSession
    path: str = field(default="")

    def __post_init__(self) -> None:
        self.path = self.path or f"{shared_folder(self.spark)}/timings-{uuid.uuid4().hex}"

    def run(self, step: str, df: DataFrame, size: F.Column, phase: str = "compression") -> DataFrame:
        """Write ``df`` and read it back; its rows, their bytes by ``size`` and the seconds are recorded under ``step``."""
        seen = Observation(f"step-{uuid.uuid4().hex}")
        out = f"{self.path}/data-{uuid.uuid4().hex}"
        began = time.perf_counter()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes")).write.parquet(out)
        seconds = time.perf_counter() - began
        found = seen.get
        row = self.spark.createDataFrame([(step, phase, int(found["rows"]), int(found["bytes"]), seconds)], TIMING)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/rows")
        return self.spark.read.schema(df.schema).parquet(out)

    def table(self) -> DataFrame:
        return self.spark.read.schema(TIMING).parquet(f"{self.path}/rows")


def measured_costs(sizes: DataFrame, timings: DataFrame, cores: int = 1) -> DataFrame:
    """Per approach: what it stores and handles, the seconds of ``cores`` cores that its steps took, and its dollars. An
    approach that was never timed has none."""
    s = sizes.groupBy("approach").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("stored_spans", "stored_bytes", "handled_bytes")])
    t = timings.groupBy(F.col("step").alias("approach")).agg((F.sum("seconds") * cores).alias("cpu_s"))
    return s.join(t, "approach", "left").withColumn("dollars", cost_dollars(F.col("stored_bytes"), F.coalesce("cpu_s", F.lit(0.0)), F.lit(0.0)))


def per_core_second(timings: DataFrame) -> DataFrame:
    """Per step: rows and bytes a second."""
    t = timings.groupBy("step").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.sum("seconds").alias("seconds"))
    return t.select("step", (F.col("rows") / F.col("seconds")).alias("rows_a_second"), (F.col("bytes") / F.col("seconds")).alias("bytes_a_second"))
