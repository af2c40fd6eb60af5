"""Structured Streaming forms of the event feeds and of dump ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kbcurate.operators import entities as E
from kbcurate.session import remove, scratch_path
from kbcurate.sources.dump import parse_entities
from kbcurate.sources.keyed import KeyedTable


def stream_evaluations(evaluations: DataFrame, watermark: str = "14 days") -> DataFrame:
    """Accepted and rejected evaluations per Monday week of a stream, for the update or append mode.

    A week's counts stay in state until the watermark passes its end; evaluations of a week
    that has ended by then are left out, late ones of an open week count.
    """
    week = F.window("created_at", "7 days", startTime="4 days")
    return (
        evaluations.withWatermark("created_at", watermark)
        .groupBy(week.alias("w"))
        .agg(F.count_if("is_accepted").alias("accepted"),
             F.count_if(~F.col("is_accepted")).alias("rejected"))
        .select(F.col("w.start").alias("week"), "accepted", "rejected")
    )


def keep_updates(
    updates: DataFrame, table: str, keys: list[str], checkpoint: str, buckets: int = 16, available_now: bool = False
) -> StreamingQuery:
    """Write a stream in update mode to a keyed table: the last row per key."""
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = scratch_path(spark, "updates")  # the keyed table reads a batch more than once
        batch.write.parquet(path)
        KeyedTable(spark, table, keys, buckets).add(spark.read.schema(batch.schema).parquet(path), number)
        remove(spark, path)

    writer = updates.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_evaluation_total(evaluations: DataFrame) -> DataFrame:
    """Running number of evaluations."""
    return evaluations.groupBy().agg(F.count(F.lit(1)).alias("total"))


_STATUS_STATE = (
    "sources array<string>, status array<string>, since array<long>, known array<boolean>, "
    "of array<int>, at array<long>, statuses array<string>, errors array<string>, codes array<int>"
)
_STATUS_CHANGE = "source_id string, status string, error string, http_status_code int, ts timestamp"

#: In how many groups sources are kept; a call for a group costs far more than to settle a source.
SOURCE_GROUPS = 4_096


def _settle(now: tuple, pending: list[tuple], until: int, expire: int | None):
    """Changes among the pending updates (at, status, error, code) before ``until`` (microseconds),
    and the state after them."""
    status, since, known = now
    due = sorted((p for p in pending if p[0] < until), key=lambda p: (p[0], p[1] is None, p[1] or ""))
    changes = []
    for update in due:
        at, new = update[:2]
        if expire is not None and known and at - since > expire:
            known = False
        if not known or new != status:
            changes.append(update)
        status, since, known = new, at, True
    return changes, (status, since, known), [p for p in pending if p[0] >= until] if due else pending


def _updates(part: pd.DataFrame) -> Iterator[tuple]:
    """(source, (at, status, error, code)) of a part's rows, missing values as None."""
    at = part["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
    source, status, error, code = (
        [None if pd.isna(v) else v for v in part[c].tolist()] for c in ("source_id", "status", "error", "http_status_code")
    )
    return zip(source, zip(at, status, error, [None if c is None else int(c) for c in code]))


def _held(state: GroupState) -> dict[str, tuple[tuple, list[tuple]]]:
    """Per source of a group its status, the time of it and if it is known, and its pending updates."""
    if not state.exists:
        return {}
    sources, status, since, known, of, *lists = state.get
    pending: list[list[tuple]] = [[] for _ in sources]
    for i, update in zip(of, zip(*lists)):
        pending[i].append(update)
    return dict(zip(sources, zip(zip(status, since, known), pending)))


def _keep(state: GroupState, held: dict[str, tuple[tuple, list[tuple]]], expire: int | None) -> None:
    """Write a group's sources, with a timer at what comes first of their updates and expiries."""
    flat = [(i, *update) for i, (_, pending) in enumerate(held.values()) for update in pending]
    nows = zip(*(now for now, _ in held.values()))
    state.update((list(held), *map(list, nows), *(map(list, zip(*flat)) if flat else [[]] * 5)))
    timers = [-(-min(u[1] for u in flat) // 1000) + 1] if flat else []
    if expire is not None:
        timers += [(now[1] + expire) // 1000 + 1 for now, pending in held.values() if not pending]
    if timers:
        state.setTimeoutTimestamp(min(timers))


def _change_frame(changes: list[tuple]) -> pd.DataFrame:
    source, at, status, error, code = zip(*changes)
    return pd.DataFrame({
        "source_id": np.array(source, object), "status": np.array(status, object), "error": np.array(error, object),
        "http_status_code": pd.array(code, "Int32"), "ts": np.array(at, "int64").view("datetime64[us]"),
    })


def _status_processor(expire: int | None):
    """Settles the sources of a group one by one; a pandas frame is made of all their changes only."""
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = max(state.getCurrentWatermarkMs(), 0) * 1000
        held = _held(state)
        if not state.hasTimedOut:
            for part in parts:
                for source, update in _updates(part):
                    if update[0] >= until:  # others were settled without them
                        held.setdefault(source, ((None, 0, False), []))[1].append(update)
        changes, kept = [], {}
        for source, (now, pending) in held.items():
            changed, now, pending = _settle(now, pending, until, expire)
            changes += [(source, *update) for update in changed]
            if pending or expire is None or now[1] + expire >= until:
                kept[source] = now, pending
        if kept:
            _keep(state, kept, expire)
        elif state.exists:
            state.remove()
        if changes:
            yield _change_frame(changes)

    return run


def status_changes(
    updates: DataFrame, delay: str = "1 hour", expire_seconds: int | None = None, groups: int = SOURCE_GROUPS
) -> DataFrame:
    """Changes (source_id, status, error, http_status_code, ts) of a stream of source updates.

    The state store holds per source its status, the time of it, and the updates that the watermark
    (``delay`` behind the newest) has not passed; a timer at the first of them settles them in the
    order of time, then status, so updates may come out of order, over batches and restarts too.
    Updates later than the watermark are left out. With ``expire_seconds``, a source silent for
    longer is forgotten - a timer drops its state - and its next update counts as a change.
    Sources share a state by their hash, ``groups`` of them (as many as at the first start, for the whole
    life of a checkpoint), so calls do not grow with the sources beyond that. What a batch writes to
    the state store follows the groups of its sources, not all sources.
    """
    expire = None if expire_seconds is None else expire_seconds * 1_000_000
    group = F.pmod(F.xxhash64("source_id"), F.lit(groups)).alias("source_group")
    return (
        updates.select("source_id", "status", "error", "http_status_code", "ts", group).withWatermark("ts", delay)
        .groupBy("source_group").applyInPandasWithState(
            _status_processor(expire), _STATUS_CHANGE, _STATUS_STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def stream_status_changes(
    updates: DataFrame, politician_sources: DataFrame, table: str, checkpoint: str, available_now: bool = False,
    delay: str = "1 hour", expire_seconds: int | None = None,
) -> StreamingQuery:
    """Append source updates that changed the status, with each politician of the source, to
    ``table``; updates that leave it as it was are silent. See :func:`status_changes`."""
    changes = status_changes(updates, delay, expire_seconds).join(politician_sources, "source_id")
    writer = changes.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def route_events(events: DataFrame, subscribers: DataFrame, tasks: int | None = None) -> DataFrame:
    """Each event ``(event_id, languages, countries)`` with each subscriber ``(subscriber_id,
    languages, countries)`` whose lists are empty or overlap it.

    An equality join on (language, country), an empty list standing for any; a pair sharing
    several keys is kept for the first only, so no state is needed to drop duplicates. Keys are
    weighed first: one that holds more than its task's share of all events is salted in as many
    parts as it has shares, and its subscribers are repeated for each; (any, any), which every
    event asks for, is only the heaviest. There are fewer heavy keys than ``tasks``.
    """
    anything = F.array(F.lit("*"))
    empty = F.array().cast("array<string>")

    def any_if_empty(c: str) -> Column:
        return F.when(F.size(c) == 0, anything).otherwise(empty)

    sent = events.select(
        "event_id", F.col("languages").alias("_el"), F.col("countries").alias("_ec"),
        F.explode(F.concat(F.array_distinct("languages"), anything)).alias("language"),
    ).withColumn("country", F.explode(F.concat(F.array_distinct("_ec"), anything)))
    wanted = subscribers.select(
        "subscriber_id", F.col("languages").alias("_sl"), F.col("countries").alias("_sc"),
        F.explode(F.concat(F.array_distinct("languages"), any_if_empty("languages"))).alias("language"),
    ).withColumn("country", F.explode(F.concat(F.array_distinct("_sc"), any_if_empty("_sc"))))
    salts = _heavy(sent, ["language", "country"], tasks)

    def first_shared(own: str, other: str) -> Column:
        shared = F.array_intersect(own, other)
        return F.coalesce(F.get(shared, F.lit(0)), F.lit("*"))

    sent = sent.join(salts, ["language", "country"], "left").withColumn(
        "salt", F.pmod(F.xxhash64("event_id"), F.coalesce("parts", F.lit(1))).cast("int")
    )
    wanted = wanted.join(salts, ["language", "country"], "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    )
    return (
        sent.join(wanted, ["language", "country", "salt"])
        .where((F.col("language") == first_shared("_el", "_sl"))
               & (F.col("country") == first_shared("_ec", "_sc")))
        .select("event_id", "subscriber_id")
    )


def _heavy(rows: DataFrame, keys: list[str], tasks: int | None) -> DataFrame:
    """(keys, parts): keys with more rows than a task's share, and how many shares they have."""
    spark = rows.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    share = max(1, total // tasks)
    heavy = counted.where(F.col("n") > share).collect()  # fewer than tasks + 1
    schema = ", ".join(f"{k} string" for k in keys) + ", parts int"
    found = [(*[r[k] for k in keys], -(-r["n"] // share)) for r in heavy]
    return F.broadcast(spark.createDataFrame(found, schema))


def stream_route_events(
    events: DataFrame, subscribers: DataFrame, table: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Route a stream's events, keys weighed per micro-batch; a batch retried replaces itself."""
    def step(batch: DataFrame, number: int) -> None:
        route_events(batch, subscribers).write.mode("overwrite").parquet(f"{table}/n={number}")

    writer = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_dump(
    spark: SparkSession, incoming: str, table: str, checkpoint: str, per_trigger: int = 16,
    available_now: bool = False, buckets: int = 16,
) -> StreamingQuery:
    """Ingest dump files as they arrive: names and relations of each micro-batch go to a keyed
    table each, ``table``/entities and ``table``/relations (see :mod:`kbcurate.sources.keyed`).
    Lines are parsed once and written to the shared folder, from which both tables take their rows."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(incoming)

    def ingest(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = scratch_path(spark, "entities")
        parsed = parse_entities(batch)
        parsed.write.parquet(path)
        entities = spark.read.schema(parsed.schema).parquet(path)
        entity_names(spark, table, buckets).add(E.names(entities), number)
        entity_relations(spark, table, buckets).add(E.extract_relations(entities), number)
        remove(spark, path)

    writer = lines.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def entity_names(spark: SparkSession, table: str, buckets: int = 16) -> KeyedTable:
    return KeyedTable(spark, f"{table}/entities", ["wikidata_id"], buckets)


def entity_relations(spark: SparkSession, table: str, buckets: int = 16) -> KeyedTable:
    return KeyedTable(spark, f"{table}/relations", ["statement_id"], buckets)
