"""A keyed table that grows by batches: hash buckets, and per batch a manifest of which file folder
holds each bucket.

A batch rewrites the buckets it touches and no other. Its manifest names them and, for all
others, the folders of earlier batches, so a reader opens one folder per bucket and meets each key
once. Folders that neither the newest manifest nor the one before it names are removed. A batch
written again replaces itself: it starts from the manifest before its own number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kbcurate.sources.tables import last_per_key

_MANIFEST = T.StructType().add("bucket", "integer").add("batch", "long")


class KeyedTable:
    """Rows by ``keys`` under ``path``; later batches win, within a batch the last by ``order``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16, order: list[str] | None = None):
        self.spark, self.path, self.keys, self.buckets, self.order = spark, path.rstrip("/"), keys, buckets, order

    def _files(self):
        """The file system of the table, whatever Spark can write to."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _hadoop_path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _listed(self, name: str, prefix: str) -> list[int]:
        """Numbers in the folder names ``prefix=<number>`` under a folder."""
        at = self._hadoop_path(name)
        files = self._files()
        if not files.exists(at):
            return []
        names = [s.getPath().getName() for s in files.listStatus(at)]
        return sorted(int(n.removeprefix(f"{prefix}=")) for n in names if n.startswith(f"{prefix}="))

    def _whole(self) -> list[int]:
        """Batches whose manifest was written to its end."""
        files = self._files()
        return [n for n in self._listed("manifest", "n") if files.exists(self._hadoop_path(f"manifest/n={n}/_SUCCESS"))]

    def _manifest(self, number: int) -> dict[int, int]:
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/n={number}").collect()
        return {r["bucket"]: r["batch"] for r in rows}

    def _folders(self, held: dict[int, int]) -> list[str]:
        return [f"{self.path}/data/batch={n}/bucket={b}" for b, n in sorted(held.items())]

    def rows(self) -> DataFrame | None:
        """The table as of the last whole batch; None before the first."""
        numbers = self._whole()
        held = self._manifest(numbers[-1]) if numbers else {}
        if not held:
            return None
        return self.spark.read.parquet(*self._folders(held))

    def add(self, batch: DataFrame, number: int) -> None:
        """Write a batch of rows (all columns of the table) under its number, which grows."""
        before = [n for n in self._whole() if n < number]
        held = self._manifest(before[-1]) if before else {}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = last_per_key(batch, self.keys, self.order).withColumn("bucket", bucket)
        columns = batch.columns
        if held:
            # which buckets are touched is asked of the keys alone
            touched = {r[0] for r in batch.select(bucket).distinct().collect()}
            old = self._folders({b: n for b, n in held.items() if b in touched})
            if old:
                stored = self.spark.read.schema(batch.schema).parquet(*old).withColumn("bucket", bucket)
                kept = stored.join(new.select(*[F.col(k).alias(f"_{k}") for k in self.keys]),
                                   [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys], "left_anti")
                new = new.unionByName(kept)
        new.select(*columns, "bucket").repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy(
            "bucket"
        ).parquet(f"{self.path}/data/batch={number}")
        written = self._listed(f"data/batch={number}", "bucket")
        now = held | dict.fromkeys(written, number)
        self.spark.createDataFrame(sorted(now.items()), _MANIFEST).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/manifest/n={number}"
        )
        self._compact({number, *before[-1:]}, [now, held])

    def _compact(self, manifests: set[int], named: list[dict[int, int]]) -> None:
        """Remove what only older manifests name."""
        files = self._files()
        used = {(n, b) for held in named for b, n in held.items()}
        for n in self._listed("data", "batch"):
            mine = self._listed(f"data/batch={n}", "bucket")
            for b in mine:
                if (n, b) not in used:
                    files.delete(self._hadoop_path(f"data/batch={n}/bucket={b}"), True)
            if not any(m == n for m, _ in used):
                files.delete(self._hadoop_path(f"data/batch={n}"), True)
        for n in self._listed("manifest", "n"):
            if n not in manifests:
                files.delete(self._hadoop_path(f"manifest/n={n}"), True)
