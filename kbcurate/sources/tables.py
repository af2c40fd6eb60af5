"""Table snapshots: upserts, soft deletes, exports and the page archive layout.

No table format with MERGE is assumed: an update is a pure function from a snapshot and a batch
to the next snapshot, written to a new folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a new snapshot; the file committer makes it visible as a whole or not at all."""
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def last_per_key(batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the last by ``order``, or the largest by all its columns without one.

    An aggregate, not a window: copies of a hot key are combined before the shuffle.
    """
    rest = [c for c in batch.columns if c not in keys]
    if not rest:
        return batch.select(*keys).distinct()
    row = F.struct(*rest)
    rank = F.struct(*(order or []), *[F.col(c).alias(f"_{c}") for c in rest])
    return batch.groupBy(*keys).agg(F.max_by(row, rank).alias("_row")).select(*keys, "_row.*")


def upsert(
    target: DataFrame,
    batch: DataFrame,
    keys: list[str],
    update_cols: list[str],
    order: list[str] | None = None,
    where: str | None = None,
    now: Column | None = None,
) -> DataFrame:
    """The target after inserting a batch: on a key conflict ``update_cols`` are overwritten
    (none: the stored row stays), everything else of the stored row is kept - a soft delete too.

    A key repeated within the batch counts once (last wins). ``where`` limits conflicts to rows
    meeting a predicate; others are always inserted. Rows with a null key never conflict.
    ``now`` stamps created_at of inserted and updated_at of touched rows.
    """
    columns = target.columns
    keyed = " AND ".join([f"`{k}` IS NOT NULL" for k in keys] + ([f"({where})"] if where else []))
    conflicting = batch.where(keyed)
    free = batch.where(f"NOT coalesce({keyed}, false)")
    latest = last_per_key(conflicting, keys, order)
    payload = [c for c in latest.columns if c in columns and c not in keys]
    new = latest.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_n_{c}") for c in payload],
        F.lit(True).alias("_new"),
    )
    stored = target.where(keyed).withColumn("_old", F.lit(True))
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    joined = stored.join(new, on, "full_outer")
    inserted, touched = F.col("_old").isNull(), F.col("_new").isNotNull()

    def merged(c: str) -> Column:
        old = F.col(c)
        if c in keys:
            return F.coalesce(old, F.col(f"_k_{c}"))
        incoming = F.col(f"_n_{c}") if c in payload else F.lit(None)
        if now is not None and c == "created_at":
            return F.when(inserted, now).otherwise(old)
        if now is not None and c == "updated_at":
            changed = touched if update_cols else inserted
            return F.when(changed, now).otherwise(old)
        if c in update_cols:
            return F.when(touched, incoming).otherwise(old)
        return F.when(inserted, incoming).otherwise(old)

    result = joined.select(
        *[merged(c).cast(target.schema[c].dataType).alias(c) for c in columns]
    )
    untouched = target.where(f"NOT coalesce({keyed}, false)")
    stamped = free.select(
        *[
            (
                now if now is not None and c in ("created_at", "updated_at")
                else F.col(c) if c in free.columns else F.lit(None)
            ).cast(target.schema[c].dataType).alias(c)
            for c in columns
        ]
    )
    return result.unionByName(untouched).unionByName(stamped)


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted_at").isNull())


def soft_delete(df: DataFrame, ids: DataFrame, key: str, at: Column) -> DataFrame:
    """Mark live rows whose key is in ``ids`` as deleted; rows already deleted keep their time."""
    marks = ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn("_gone", F.lit(True))
    columns = [c for c in df.columns if c != "deleted_at"]
    return df.join(marks, key, "left").select(
        *columns,
        F.when(F.col("deleted_at").isNull() & F.col("_gone").isNotNull(), at)
        .otherwise(F.col("deleted_at")).alias("deleted_at"),
    ).select(*df.columns)


def named(ids: DataFrame, entities: DataFrame) -> DataFrame:
    """(wikidata_id, name) of a typed table; names live in the entity table."""
    return ids.select("wikidata_id").join(entities.select("wikidata_id", "name"), "wikidata_id")


def export_named(df: DataFrame, path: str) -> None:
    """CSV of (wikidata_id, name), ordered by id across files (range-partitioned sort)."""
    df.select("wikidata_id", "name").orderBy("wikidata_id").write.option("header", True).csv(path)


def write_documents(docs: DataFrame, path: str, rows_per_file: int = 50_000) -> None:
    """Search documents as JSON lines, at most ``rows_per_file`` in a file."""
    docs.write.option("maxRecordsPerFile", rows_per_file).json(path)


def documents_to_delete(before: DataFrame, after: DataFrame, key: str = "wikidata_id") -> DataFrame:
    """Ids an index holds that are gone after a cleanup."""
    return before.select(key).distinct().join(after.select(key), key, "left_anti")


def url_hash(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def archive_path(url: Column, fetched_at: Column) -> Column:
    """``YYYY/MM/DD/<hash>`` of an archived page."""
    return F.concat_ws("/", F.date_format(fetched_at, "yyyy/MM/dd"), url_hash(url))


def write_archive(pages: DataFrame, path: str) -> None:
    """Archived pages laid out by fetch date, each with its place in the archive."""
    (
        pages.withColumn("path", archive_path(F.col("url"), F.col("fetch_timestamp")))
        .withColumn("fetch_date", F.to_date("fetch_timestamp"))
        .write.partitionBy("fetch_date").parquet(path)
    )
