"""Streams as streams: state, watermarks, restarts and what the keyed table rewrites."""

import datetime as dt
import random
from pathlib import Path

import pandas as pd
import pytest

from kbcurate.session import scratch_path
from kbcurate.sources.keyed import KeyedTable
from kbcurate.streaming import streams

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def folder(spark):
    return scratch_path(spark, "streams")


def data_files(path):
    return sorted(str(f.relative_to(path)) for f in Path(path).glob("data/**/*.parquet"))


def test_keyed_table_rewrites_only_touched_buckets(spark, folder):
    table = KeyedTable(spark, folder, ["k"], buckets=8)
    assert table.rows() is None
    expected = {}
    sizes = []
    for n in range(6):
        rows = [(k, f"{n}-{k}") for k in ([3, 5] if n else range(200))]
        expected |= dict(rows)
        before = set(data_files(folder))
        table.add(spark.createDataFrame(rows, "k long, v string"), n)
        fresh = set(data_files(folder)) - before
        assert len(fresh) <= (2 if n else 8)
        got = [tuple(r) for r in table.rows().collect()]
        assert len(got) == 200 and dict(got) == expected
        assert len(table.rows().inputFiles()) <= 8
        sizes.append(len(data_files(folder)))
    assert max(sizes) <= 8 + 2 + 2  # the newest manifest's and the one before it
    assert len(list(Path(folder).glob("manifest/n=*"))) == 2


def test_keyed_table_replaces_a_retried_batch(spark, folder):
    table = KeyedTable(spark, folder, ["k"], buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    table.add(frame([(1, "a"), (2, "a"), (None, "n")]), 0)
    table.add(frame([(1, "lost")]), 1)
    table.add(frame([(2, "b"), (None, "m"), (9, "b")]), 1)  # the same batch again, with what it reads now
    assert sorted(map(tuple, table.rows().collect()), key=str) == [(1, "a"), (2, "b"), (9, "b"), (None, "m")]
    table.add(frame([]), 2)
    assert table.rows().count() == 4


def run_parts(spark, folder, parts, schema, start):
    """One file a part; the query drains it, stops and starts again."""
    out = []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        query = start(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        query.awaitTermination()
        out.append(query)
    return out


def test_late_evaluations_and_bounded_state(spark, folder):
    schema = "created_at timestamp, is_accepted boolean"
    day = lambda n, ok=True: (T0 + dt.timedelta(days=n), ok)
    parts = [[day(0), day(1, False)], [day(7 * w) for w in range(1, 20)], [day(2), day(7 * 19 + 1, False), day(7 * 18)]]
    queries = run_parts(spark, folder, parts, schema, lambda s: streams.keep_updates(
        streams.stream_evaluations(s), f"{folder}/weeks", ["week"], f"{folder}/state", 4, available_now=True
    ))
    got = {r["week"]: (r["accepted"], r["rejected"]) for r in KeyedTable(spark, f"{folder}/weeks", ["week"], 4).rows().collect()}
    week = lambda n: T0 + dt.timedelta(days=7 * n)
    assert got[week(0)] == (1, 1)  # the late one was left out
    assert got[week(18)] == (2, 0) and got[week(19)] == (1, 1)  # late, but their weeks were open
    held = queries[-1].lastProgress["stateOperators"][0]["numRowsTotal"]
    assert held <= 4  # of 20 weeks


def plain_changes(rows, until, expire=None):
    out, state = [], {}
    for source, status, error, code, ts in sorted(rows, key=lambda r: (r[0], r[4], r[1])):
        if ts >= until:
            continue
        before = state.get(source)
        if before and expire and ts - before[1] > expire:
            before = None
        if before is None or before[0] != status:
            out.append((source, status, error, code, ts))
        state[source] = (status, ts)
    return sorted(out)


UPDATE = "source_id string, status string, error string, http_status_code int, ts timestamp"


@pytest.mark.parametrize("expire", [None, 4 * 3600])
def test_status_changes_out_of_order_over_restarts(spark, folder, expire):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        ts = T0 + dt.timedelta(seconds=rng.randrange(48 * 3600), microseconds=rng.randrange(10**6))
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(15)}"
        status = rng.choice(["PENDING", "DONE", "DONE", None])
        rows.append((source, status or "ERROR", None if status else "TIMEOUT", None if status else 504, ts))
    arrival = sorted(rows, key=lambda r: r[4] + dt.timedelta(minutes=rng.randrange(50)))
    parts = [arrival[:200], arrival[200:430], arrival[430:]]
    sources = spark.createDataFrame(
        [(s, f"p-{s}") for s in {r[0] for r in rows}], "source_id string, politician_id string"
    )
    run_parts(spark, folder, parts, UPDATE, lambda s: streams.stream_status_changes(
        s, sources, f"{folder}/out", f"{folder}/state", True, "1 hour", expire
    ))
    got = sorted(
        (r["source_id"], r["status"], r["error"], r["http_status_code"], r["ts"])
        for r in spark.read.parquet(f"{folder}/out").collect()
    )
    newest = max(r[4] for r in rows)
    until = newest.replace(microsecond=newest.microsecond // 1000 * 1000) - dt.timedelta(hours=1)
    want = plain_changes(rows, until, expire and dt.timedelta(seconds=expire))
    assert got == want


def test_status_changes_of_one_hot_source_in_any_order(spark, folder):
    rng = random.Random(5)
    rows = [("hot", "ABC"[(i // 1000) % 3], None, None, T0 + dt.timedelta(seconds=i)) for i in range(40_000)]
    first, second = rows[:25_500], [*rows[24_500:], ("cold", "B", None, None, T0 + dt.timedelta(seconds=39_000))]
    parts = [rng.sample(part, len(part)) for part in (first, second)]
    sources = spark.createDataFrame([("hot", "p1"), ("cold", "p2")], "source_id string, politician_id string")
    run_parts(spark, folder, [*parts, [("end", "A", None, None, T0 + dt.timedelta(days=9))]], UPDATE, lambda s: (
        streams.stream_status_changes(s, sources, f"{folder}/out", f"{folder}/state", True)
    ))
    got = [r["source_id"] for r in spark.read.parquet(f"{folder}/out").collect()]
    assert got.count("hot") == 40 and got.count("cold") == 1


def test_sources_share_a_state_and_a_frame(monkeypatch):
    """A group of many sources is settled in one call; the only pandas frame is that of its changes."""
    class State:
        exists = hasTimedOut = False

        def getCurrentWatermarkMs(self):
            return self.passed

        def update(self, value):
            self.get, self.exists = value, True

        def setTimeoutTimestamp(self, at):
            self.timer = at

        def remove(self):
            self.exists = False

    part = pd.DataFrame({
        "source_id": ["s", "t", "s", "t"], "status": ["B", "A", None, "A"], "error": [None, "e", None, None],
        "http_status_code": [None, 504, None, 200], "ts": [pd.Timestamp(T0) + pd.Timedelta(microseconds=n) for n in (2, 1, 3, 5001)],
    })
    frame, made = pd.DataFrame, []
    monkeypatch.setattr(streams.pd, "DataFrame", lambda *args, **named: made.append(1) or frame(*args, **named))
    run, state, first = streams._status_processor(1_000_000), State(), pd.Timestamp(T0).value // 1_000_000
    state.passed = first
    assert list(run((7,), iter([part]), state)) == [] and not made
    assert state.timer == first + 2
    state.passed, state.hasTimedOut = first + 3, True
    (got,) = run((7,), iter([]), state)
    assert len(made) == 1
    rows = [[None if pd.isna(v) else v for v in r] for r in got.drop(columns="ts").itertuples(index=False)]
    assert rows == [["s", "B", None, None], ["s", None, None, None], ["t", "A", "e", 504]]
    assert state.get[0] == ["s", "t"] and state.get[4:] == ([1], [first * 1000 + 5001], ["A"], [None], [200])
    assert state.timer == first + 7  # before the second in which "s" is forgotten is over
    state.passed = first + 1001
    assert list(run((7,), iter([]), state)) == [] and state.get[0] == ["t"]
    state.passed = first + 1007
    assert list(run((7,), iter([]), state)) == [] and not state.exists


def test_status_state_follows_the_batch(spark, folder):
    """Many sources once, then one source again and again: a batch writes the state of its sources."""
    many = [(f"s{i}", "DONE", None, None, T0) for i in range(2000)]
    one = [[("s1", "PENDING", None, None, T0 + dt.timedelta(hours=5 * n))] for n in range(1, 4)]
    sources = spark.createDataFrame([("s1", "p1")], "source_id string, politician_id string")
    queries = run_parts(spark, folder, [many, *one], UPDATE, lambda s: streams.stream_status_changes(
        s, sources, f"{folder}/out", f"{folder}/state", True
    ))
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in queries[-1].recentProgress if p["stateOperators"]]
    assert max(updated) <= 2


def test_routing_spreads_every_heavy_key(spark):
    """A third of all events in one language: its key is salted like (any, any)."""
    events = spark.range(3000).selectExpr(
        "id AS event_id", "array(CASE WHEN id % 3 = 0 THEN 'en' ELSE concat('l', id % 50) END) AS languages",
        "array(concat('c', id % 7)) AS countries",
    )
    subscribers = spark.createDataFrame(
        [(1, ["en"], []), (2, [], []), (3, ["l1", "en"], ["c1"]), (4, [], ["c2", "c3"]), (5, ["xx"], [])],
        "subscriber_id long, languages array<string>, countries array<string>",
    )
    sent = events.selectExpr("event_id", "explode(array(languages[0], '*')) AS language", "countries[0] AS c").selectExpr(
        "event_id", "language", "explode(array(c, '*')) AS country"
    )
    parts = {(r["language"], r["country"]): r["parts"] for r in streams._heavy(sent, ["language", "country"], 24).collect()}
    assert parts[("*", "*")] >= 3 and parts[("en", "*")] >= 2 and len(parts) <= 24
    got = sorted(map(tuple, streams.route_events(events, subscribers, 24).collect()))
    want = sorted(
        (i, s) for i in range(3000) for s, ls, cs in [(1, ["en"], []), (2, [], []), (3, ["l1", "en"], ["c1"]), (4, [], ["c2", "c3"]), (5, ["xx"], [])]
        if (not ls or ("en" if i % 3 == 0 else f"l{i % 50}") in ls) and (not cs or f"c{i % 7}" in cs)
    )
    assert got == want
    assert streams.route_events(events.where("event_id < 0"), subscribers).count() == 0


def test_dump_is_read_back_once_per_key(spark, folder):
    """The same entities arrive in every batch: files do not grow, the newest rows are read."""
    lines = lambda n: [(
        '{"id": "Q%d", "labels": {"en": {"language": "en", "value": "name %d of %d"}}, "claims": {}},' % (i, n, i),
    ) for i in range(30)]
    counts = []
    for n in range(4):
        spark.createDataFrame(lines(n), "value string").coalesce(1).write.mode("append").text(f"{folder}/in")
        streams.stream_dump(spark, f"{folder}/in", f"{folder}/t", f"{folder}/state", 1, True, buckets=4).awaitTermination()
        rows = streams.entity_names(spark, f"{folder}/t", 4).rows()
        assert sorted(r["name"] for r in rows.collect()) == sorted(f"name {n} of {i}" for i in range(30))
        counts.append((len(rows.inputFiles()), len(data_files(f"{folder}/t/entities"))))
    assert counts[1] == counts[2] == counts[3]
