"""Intermediate tables in the shared folder, and joins that pick their strategy from a count."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from kbcurate.session import scratch_path

#: At most this many 64-bit ids are broadcast (about 16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


class Scratch:
    """Tables written once to the folder all executors share, so that a lost executor costs no
    finished step, and removed when the next step no longer needs them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.paths = spark, scratch_path(spark, name), []

    def write(self, df: DataFrame, *observed) -> DataFrame | tuple[DataFrame, dict]:
        """``df`` written and read back; with aggregates, also their values over it."""
        path = f"{self.base}/{len(self.paths)}"
        self.paths.append(path)
        seen = Observation()
        (df.observe(seen, *observed) if observed else df).write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table.scratch = path
        return (table, seen.get) if observed else table

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables written here that nothing reads any more."""
        for table in tables:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def sweep(self) -> None:
        """Have shuffle files of finished steps removed now. Spark removes them once the driver's
        garbage collection meets their plans, which may be after the job in a driver with little to do."""
        gc.collect()
        self.spark._jvm.System.gc()


def count_rows():
    return F.count(F.lit(1)).alias("n")


def sized(ids: DataFrame, n: int) -> DataFrame:
    """Broadcast a side of ``n`` rows of a few numbers if it is small; else Spark shuffles."""
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids
