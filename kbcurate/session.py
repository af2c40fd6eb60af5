"""Session helpers: a local session for tests, and lineage cutting that survives executor loss."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def local_session(cores: int | str = "*", app: str = "kbcurate") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    n = 8 if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.default.parallelism", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # cheaper plan building
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def one_process(master: str) -> bool:
    """Whether a master URL runs executors inside the driver."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: the session's checkpoint directory.

    A cluster names it in ``spark.checkpoint.dir``. Where nothing is set, a temporary one is made
    if driver and executors are one process, and anything else is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not one_process(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="spark-kbcurate-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at durable files, the
    work is done once, and the reader knows the size (so joins pick their strategy from it)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def written_once(df: DataFrame, name: str) -> DataFrame:
    """:func:`written`, with the shuffle files of this step and those before it removed now. Spark removes them
    when the driver's garbage collection meets their plans, which may be after the job in a driver with
    little to do."""
    table = written(df, name)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`written` that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table.scratch)


def shuffled(keys: DataFrame) -> DataFrame:
    """Keys that grow with the input, to be joined by a shuffle at every size. Spark takes what is read from
    a wide nested table to be far smaller than it is, and would send millions of ids to the driver to
    broadcast them."""
    return keys.hint("merge")


def written_counted(df: DataFrame, path: str) -> int:
    """Write ``df`` to ``path`` and return its number of rows, observed while writing."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return seen.get["n"]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
