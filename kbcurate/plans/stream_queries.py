"""Streaming queries over the bundled event log, run to the end of the available data."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from kbcurate.plans.dump_queries import NAMES_SQL, RELATIONS_SQL
from kbcurate.plans.registry import query
from kbcurate.plans.views import Catalog
from kbcurate.session import scratch_path
from kbcurate.sources.keyed import KeyedTable
from kbcurate.streaming import streams as X


def _event_stream(c: Catalog) -> DataFrame:
    schema = c.table("events").schema
    return c.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(c.folder)


def _drained(c: Catalog, out: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all it has now and read what it wrote."""
    path = scratch_path(c.spark, name)
    writer: DataStreamWriter = out.writeStream.outputMode(mode).trigger(availableNow=True).option(
        "checkpointLocation", f"{path}/state"
    )
    if mode == "append":
        writer.format("parquet").option("path", f"{path}/rows").start().awaitTermination()
    else:
        def store(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/rows/n={number}")

        writer.foreachBatch(store).start().awaitTermination()
        rows = c.spark.read.parquet(f"{path}/rows")
        return rows.where(F.col("n") == rows.agg(F.max("n")).scalar()).drop("n")
    return c.spark.read.schema(out.schema).parquet(f"{path}/rows")


def _evaluations(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin("purchase", "error")).select(
        F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_type") == "purchase").alias("is_accepted")
    )


def _in_parts(c: Catalog, parts: list[DataFrame], name: str, run) -> str:
    """Files of a part arrive, ``run(stream, folder)`` drains them and stops, and starts again from
    its checkpoint for the next part. The folder of the stream."""
    base = scratch_path(c.spark, name)
    for part in parts:
        part.write.mode("append").parquet(f"{base}/incoming")
        run(c.spark.readStream.schema(part.schema).parquet(f"{base}/incoming"), base).awaitTermination()
    return base


@query("""WITH last AS (SELECT max(ts) AS m FROM events)
    SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS STRING) AS week,
    sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS accepted,
    sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS rejected
    FROM (SELECT ts, event_type FROM events
          UNION ALL SELECT ts, event_type FROM events, last WHERE ts >= m - INTERVAL 3 DAYS)
    WHERE event_type IN ('purchase', 'error') GROUP BY 1""")
def stream_evaluations(c: Catalog) -> DataFrame:
    """Events before the middle of the month, then the rest, then late ones: all of the first three
    days again, whose week the watermark has closed, and all of the last three, which count."""
    events = c.table("events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    middle, ts, days = first + (last - first) / 2, F.col("ts"), timedelta(days=3)
    parts = [events.where(ts < middle), events.where(ts >= middle), events.where((ts < first + days) | (ts >= last - days))]
    base = _in_parts(c, parts, "weeks", lambda stream, base: X.keep_updates(
        X.stream_evaluations(_evaluations(stream)), f"{base}/weeks", ["week"], f"{base}/state", available_now=True
    ))
    weeks = KeyedTable(c.spark, f"{base}/weeks", ["week"]).rows()
    return weeks.select(F.date_format("week", "yyyy-MM-dd").alias("week"), "accepted", "rejected")


@query("SELECT count(*) AS total FROM events WHERE event_type IN ('purchase', 'error')")
def stream_evaluation_total(c: Catalog) -> DataFrame:
    return _drained(c, X.stream_evaluation_total(_evaluations(_event_stream(c))), "total", "complete")


@query("""
    WITH steps AS (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM events),
    passed AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 12 HOURS AS w FROM events)
    SELECT 'src-' || CAST(user_id AS STRING) AS source_id, 'pol-' || CAST(user_id AS STRING) AS politician_id,
           event_type AS status, CAST(ts AS STRING) AS ts
    FROM steps, passed WHERE ts < w AND (before IS NULL OR before <> event_type)""")
def stream_status_changes(c: Catalog) -> DataFrame:
    """Users' event types as the status of a source each, with one politician. Events come up to six
    hours out of order and over two restarts; the last twelve hours are still open at the end."""
    jitter = F.pmod(F.xxhash64("event_id"), F.lit(6 * 3600))
    events = c.table("events").withColumn("arrival", F.col("ts").cast("timestamp") + F.make_interval(secs=jitter))
    first, last = events.agg(F.min("arrival"), F.max("arrival")).first()
    third = (last - first) / 3
    at = F.col("arrival")
    parts = [events.where(at < first + third), events.where((at >= first + third) & (at < first + 2 * third)),
             events.where(at >= first + 2 * third)]
    source = F.concat(F.lit("src-"), F.col("user_id").cast("string")).alias("source_id")
    sources = c.table("events").select(
        source, F.concat(F.lit("pol-"), F.col("user_id").cast("string")).alias("politician_id")
    ).distinct()

    def run(stream: DataFrame, base: str):
        updates = stream.select(
            source, F.col("event_type").alias("status"), F.lit(None).cast("string").alias("error"),
            F.lit(None).cast("int").alias("http_status_code"), F.col("ts").cast("timestamp").alias("ts"),
        )
        return X.stream_status_changes(
            updates, sources, f"{base}/changes", f"{base}/state", available_now=True, delay="12 hours"
        )

    base = _in_parts(c, parts, "changes", run)
    return c.spark.read.parquet(f"{base}/changes").select(
        "source_id", "politician_id", "status", F.col("ts").cast("string").alias("ts")
    )


@query("""
    SELECT e.event_id, n.n_nationkey AS subscriber_id FROM events e JOIN nation n
      ON (n.n_nationkey % 5 = 0 OR n.n_nationkey % 7 IN (e.event_id % 7, (e.event_id + 1) % 7))
     AND (n.n_nationkey % 4 = 0 OR n.n_nationkey = e.user_id % 25)""")
def route_events(c: Catalog) -> DataFrame:
    """Events in two languages and one country; nations as subscribers, some without a filter."""

    def name(prefix: str, k: Column) -> Column:
        return F.concat(F.lit(prefix), k.cast("string"))

    e, n = F.col("event_id"), F.col("n_nationkey")
    empty = F.array().cast("array<string>")
    events = _event_stream(c).select(
        "event_id", F.array(name("L", e % 7), name("L", (e + 1) % 7)).alias("languages"),
        F.array(name("N", F.col("user_id") % 25)).alias("countries"),
    )
    subscribers = c.table("nation").select(
        n.alias("subscriber_id"),
        F.when(n % 5 == 0, empty).otherwise(F.array(name("L", n % 7))).alias("languages"),
        F.when(n % 4 == 0, empty).otherwise(F.array(name("N", n))).alias("countries"),
    )
    path = scratch_path(c.spark, "routed")
    X.stream_route_events(events, subscribers, f"{path}/rows", f"{path}/state", available_now=True).awaitTermination()
    return c.spark.read.parquet(f"{path}/rows").select("event_id", "subscriber_id")


@query(f"""
    SELECT 'entity' AS kind, wikidata_id AS a, CAST(NULL AS STRING) AS b, description AS c, name AS d FROM ({NAMES_SQL})
    UNION ALL
    SELECT 'relation', parent_entity_id, child_entity_id, relation_type, statement_id FROM ({RELATIONS_SQL})""")
def stream_dump(c: Catalog) -> DataFrame:
    """The dump written to files, ingested as they arrive: names and relations of the keyed tables."""
    from kbcurate.plans.dump_lines import dump_lines

    base = scratch_path(c.spark, "dump-stream")
    dump_lines(c).repartition(4).write.text(f"{base}/incoming")
    X.stream_dump(
        c.spark, f"{base}/incoming", f"{base}/tables", f"{base}/state", per_trigger=2, available_now=True
    ).awaitTermination()
    names = X.entity_names(c.spark, f"{base}/tables").rows()
    relations = X.entity_relations(c.spark, f"{base}/tables").rows()
    none = F.lit(None).cast("string")
    return names.select(
        F.lit("entity").alias("kind"), F.col("wikidata_id").alias("a"), none.alias("b"), F.col("description").alias("c"),
        F.col("name").alias("d"),
    ).union(relations.select(F.lit("relation"), "parent_entity_id", "child_entity_id", "relation_type", "statement_id"))
