"""Ranked search against a plain scoring of every document."""

import math
import random
import re

import pytest

from kbcurate.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=50):
    counted = [(i, split(t)) for i, t in docs]
    used = [(i, ts) for i, ts in counted if ts]
    n, length = len(used), sum(len(ts) for _, ts in used)
    df = {}
    for _, ts in used:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(split(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, ts in used:
            m = 50 + (50 * len(ts) * n) // length
            score = 0
            for t in terms & set(ts):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                tf = ts.count(t)
                score += w * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, i, -score))
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    out = lexical.search(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **more
    )
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def corpus(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return rng, vocabulary, [
        (i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 30, 200])))) for i in range(n)
    ]


@pytest.mark.parametrize("segment, block, short", [(16_384, 512, 64), (200, 16, 4), (64, 8, 1), (64, 8, 10_000)])
def test_whole_ranking(spark, segment, block, short):
    """Short lists only, long lists only and both; many segments and blocks."""
    rng, vocabulary, docs = corpus(segment, 700)
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 12])))) for k in range(25)]
    shape = dict(segment=segment, block=block, rare=short)
    assert found(spark, docs, items, **shape) == brute(docs, items)
    assert found(spark, docs, items, top=3, **shape) == brute(docs, items, 3)


def test_blocks_are_skipped(monkeypatch):
    """With a high fiftieth score most blocks are not looked at, and nothing is lost."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(1)
    lists = [sorted(set(rng.choices(range(40), k=6))) for _ in range(20_000)]
    times = [[rng.choice([1, 1, 2, 9]) for _ in x] for x in lists]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(20_000)), pa.array([sum(t) for t in times], pa.int64()), pa.array(lists, pa.list_(pa.int32())),
         pa.array(times, pa.list_(pa.int64()))], names=["id", "n", "terms", "times"],
    )
    segment = lexical._Segment([batch], np.arange(1, 41) ** 3, 20_000, 200_000)
    looked = []
    plain = lexical._gain_of
    monkeypatch.setattr(lexical, "_gain_of", lambda d, g, w: looked.append(len(w)) or plain(d, g, w))
    best = lexical._Best(50)
    lexical._rank(segment, np.array([39, 38, 2, 1]), best)
    total = {}
    for t in (39, 38, 2, 1):
        for d, g in zip(*segment.postings(t)):
            total[d] = total.get(d, 0) + g
    exact = sorted(((-s, d) for d, s in total.items()))[:50]
    assert [(-s, d) for s, d in zip(best.scores, best.ids)] == [(s, d) for s, d in exact]
    assert sum(looked) < len(total)


def test_edges(spark):
    docs = [
        (1, "Apple pear"), (2, "apple pear"), (2, "apple pear"), (None, "pear"), (3, None), (4, ""), (5, "...---"),
        (6, "ÄPFEL äpfel İX"), (7, "x" * 100 + " apple " + "pear " * 300_000), (8, "a1b2_c3"),
    ]
    items = [(1, "APPLE apple"), (1, "pear"), (2, None), (3, ""), (4, "Äpfel"), (None, "c3 b2 a1b2"), (5, "nowhere"), (6, "İx")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == []


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS_A_BLOCK", 4)
    rng, vocabulary, docs = corpus(9, 60)
    items = [(k, rng.choice(vocabulary)) for k in range(11)]
    assert found(spark, docs, items) == brute(docs, items)


def test_long_texts_are_split_in_pieces(monkeypatch):
    text = "Ab cd,é1 " * 50
    whole = lexical.terms(text)
    monkeypatch.setattr(lexical, "PIECE", 7)
    assert lexical.terms(text) == whole == {b"ab": 50, b"cd": 50, "é1".encode(): 50}


def test_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2)], "doc_id long, text string, id long, score long")
    items = spark.createDataFrame([(1, "a", 3)], "item_id long, text string, item long")
    assert [tuple(r)[:3] for r in lexical.search(docs, items).collect()] == [(1, 1, 1)]
