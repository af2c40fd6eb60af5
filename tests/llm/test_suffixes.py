"""Prefix doubling over bytes against a brute-force search for repeated strings."""

import hashlib
import random

import numpy as np
import pytest

from kbcurate.llm import suffixes
from kbcurate.llm.queries import QUERIES
from kbcurate.llm.suffixes import GRAM, WINDOW, phrases_of, remove_repeated_bytes

FOLDER = "/root/testdata/sf0.001"


def brute(texts, size=400):
    """Spans covered by strings that start at two places or more."""
    seen = {}
    for t in texts:
        for p in range(len(t) - size + 1):
            key = t[p:p + size]
            seen[key] = seen.get(key, 0) + 1
    out = []
    for t in texts:
        spans = []
        for p in range(len(t) - size + 1):
            if seen[t[p:p + size]] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], p + size)
                else:
                    spans.append((p, p + size))
        out.append(spans)
    return out


def check(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {
        r["row"]["doc_id"]: r
        for r in remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    }
    raw = [(t or "").encode() for t in texts]
    for i, (t, spans) in enumerate(zip(raw, brute(raw))):
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + t[at:a], b
        assert [(s["start"], s["end"]) for s in got[i]["spans"]] == spans, i
        assert bytes(got[i]["kept"]) == kept + t[at:]
        assert (got[i]["n_bytes"], got[i]["n_removed"]) == (len(t), sum(b - a for a, b in spans))


def noise(rng, n):
    return "".join(rng.choice("abcdefghij éü\n") for _ in range(n))


def test_ends_are_exact(spark):
    """Passages of 380 to 700 bytes at the start, inside and at the end, shared in full or in part."""
    rng = random.Random(5)
    passages = [noise(rng, n) for n in (360, 380, 395, 400, 410, 500, 700)]
    texts = []
    for i in range(60):
        p = rng.choice(passages)
        a, b = sorted((rng.randrange(60), len(p) - rng.randrange(60)))
        parts = [noise(rng, rng.choice([0, 5, 300])), p[a:b], noise(rng, rng.choice([0, 7, 300]))]
        texts.append("".join(parts))
    check(spark, texts)


def test_edges(spark):
    rng = random.Random(6)
    long = noise(rng, 3000)
    check(spark, [
        None, "", "x", "a" * 399, "a" * 400, "b" * 401, "ab" * 700, long, long, long[:399], long[100:520],
        "Der " * 300, noise(rng, 900) + "Der " * 150, "é" * 500, long[::-1],
    ])


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rng = random.Random(7)
    t, other = noise(rng, 600), noise(rng, 600)
    rows = [(1, t, 1, "a"), (1, t, 2, "b"), (None, other, 3, "c"), (None, other, 4, None), (None, None, 5, "d"), (3, noise(rng, 500), 6, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tid long, spans string")
    got = {r["row"]["tid"]: r for r in remove_repeated_bytes(df).collect()}
    assert [got[k]["n_removed"] for k in range(1, 7)] == [len(t.encode())] * 2 + [len(other.encode())] * 2 + [0, 0]
    assert got[5]["n_bytes"] == 0 and got[4]["row"]["spans"] is None
    assert remove_repeated_bytes(df.where("tid > 100")).count() == 0


def test_long_texts_are_picked_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(8)
    text = bytes(rng.integers(97, 102, 9000, dtype=np.uint8))
    (whole,) = phrases_of([text], GRAM, WINDOW)
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    (pieces,) = phrases_of([text], GRAM, WINDOW)
    assert all((a == b).all() for a, b in zip(whole, pieces))


def test_one_very_long_text(spark):
    rng = random.Random(9)
    part = noise(rng, 450)
    text = noise(rng, 1_200_000) + "A" + part + "B" + noise(rng, 1000) + "C" + part
    (row,) = remove_repeated_bytes(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    size = len(part.encode())
    at = len(text.encode()) - size
    first = text.encode().index(part.encode())
    assert [(s["start"], s["end"]) for s in row["spans"]] == [(first, first + size), (at, at + size)]


def test_query(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op11_suffix_dedup"](spark, FOLDER).collect()}
    raw = [(r["text"] or "").encode() for r in table]
    assert len(got) == len(raw)
    removed = 0
    for r, t, spans in zip(table, raw, brute(raw)):
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + t[at:a], b
        mine = got[r["doc_id"]]
        removed += mine["n_removed"]
        assert (mine["n_bytes"], mine["n_removed"], mine["n_spans"], mine["kept_sha256"]) == (
            len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept + t[at:]).hexdigest()
        )
    assert removed > 0


def broadcasts(spark):
    """Broadcasts of all queries that the session has run."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    graphs = [store.planGraph(runs.apply(i).executionId()).allNodes() for i in range(runs.size())]
    return sum(g.apply(i).name() == "BroadcastExchange" for g in graphs for i in range(g.size()))


def test_nothing_that_grows_with_the_texts_is_broadcast(spark):
    rng = random.Random(8)
    shared = [noise(rng, 450) for _ in range(3)]
    texts = [noise(rng, 600) + rng.choice(shared)[rng.randrange(60):] + noise(rng, 300) for _ in range(12)]
    before = broadcasts(spark)
    check(spark, texts + texts[:2])
    assert broadcasts(spark) == before
