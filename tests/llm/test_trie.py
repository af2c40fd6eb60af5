"""The prefix trie against a plain one built in memory, over one shard and many."""

import hashlib
import random
import zlib

import pytest

from kbcurate.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), key, role, text))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    nodes = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        group = int(c - (abs(c) % 100) * (1 if c >= 0 else -1))
        path = tuple(own.get(group, [])[:h] + mine[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, d == len(path)))
    out = []
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def subtree(p):
        todo, leaves, saved = [p], 0, 0
        while todo:
            q = todo.pop()
            below = children.get(q, [])
            leaves += not below
            saved += (len(nodes[q]) - 1) * len(q[-1][1]) if q else 0
            todo += below
        return leaves, saved

    for p, members in nodes.items():
        leaves, saved = subtree(p)
        ends = ",".join(str(c) for c in sorted(c for c, end in members if end))
        out.append((
            min(c for c, _ in members), len(p), min(c for c, _ in nodes[p[:-1]]) if p else None, len(members),
            len(children.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in trie.prefix_trie(df, **more).collect()), key=repr)


@pytest.mark.parametrize("parts, shard_turns", [("1", 1_000_000), ("8", 1_000_000), ("5", 20)])
def test_small_alphabet(spark, parts, shard_turns):
    rng = random.Random(3)
    rows = []
    for c in range(-30, 320):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", None, "é"]), rng.choice(["a", "bb", "", "üü", None])))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert found(spark, rows, shard_turns=shard_turns) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_copies_are_spread_over_shards(spark):
    """One conversation in most rows: its path is on the skeleton and its ids are hashed in order."""
    rows = [(100 * c, t, "user", f"same {t}") for c in range(900) for t in range(3)]
    rows += [(100 * c, t, "user", f"{c} {t}") for c in range(900, 1000) for t in range(2)]
    got = found(spark, rows, shard_turns=300)
    assert got == brute(rows)
    assert (0, 3, 0, 900, 0, 1, 899 * 6) in [r[:7] for r in got]


def test_edges(spark):
    rows = [
        (0, 2, "user", "b"), (0, None, "user", "a"), (0, None, "user", "a"), (0, 1, None, None), (0, 1, "user", None),
        (None, 1, "user", "lost"), (1, 5, "user", "x" * 70_000), (7_000_000_001, 1, "user", "no first conversation"),
        (7_000_000_001, 1, "user", "no first conversation"), (5, 0, "", ""), (5, 0, "", ""),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_extra_columns_and_names(spark):
    rows = [(1, 0, "user", "a", 5, "p"), (2, 0, "user", "a", 6, "q")]
    df = spark.createDataFrame(rows, SCHEMA + ", shard long, path string")
    assert sorted(map(tuple, trie.prefix_trie(df).collect()), key=repr) == brute([r[:4] for r in rows])


def test_skeleton_numbers_are_preorder():
    a, b, c = (bytes([x]) * trie.TURN for x in (1, 2, 3))
    number, nodes = trie.skeleton_of([a + b, a + c, c])
    assert nodes == [(0, -1, 4), (1, 0, 3), (2, 1, 2), (2, 1, 3), (1, 0, 4)]
    assert number[(1, c)] == 3
