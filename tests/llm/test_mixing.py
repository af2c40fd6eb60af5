import random
import re

import pytest

from kbcurate.llm import mixing


def fill(sizes, weights, repeats=3):
    """Targets by raising one level until the total is shared."""
    total, stopped = sum(sizes), set()
    while True:
        rest = total - sum(repeats * sizes[i] for i in stopped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in stopped)
        level = rest / w if w else 0
        new = {i for i in range(len(sizes)) if i not in stopped and repeats * sizes[i] <= level * weights[i]}
        if not new:
            return [repeats * s if i in stopped else level * weights[i] for i, s in enumerate(sizes)]
        stopped |= new


def sainte_lague(weights, limits, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        free = [i for i in range(len(weights)) if got[i] < limits[i] and weights[i] > 0]
        if not free:
            break
        best = max(free, key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_apportion_gives_the_highest_quotients(spark, seed):
    rng = random.Random(seed)
    rows = [(g, i, rng.choice([0, 1, 3, 50, 1000, rng.randint(1, 5000)])) for g in range(4) for i in range(rng.randint(1, 15))]
    seats = {g: rng.randint(0, 200) for g in range(4)}
    df = spark.createDataFrame([(g, i, w, 10**6, seats[g]) for g, i, w in rows], "g int, i int, w long, cap long, seats long")
    got = {(r["g"], r["i"]): r["quota"] for r in mixing.apportion(df, ["g"], ["i"], "w", "cap", "seats").collect()}
    for g in range(4):
        mine = [(i, w) for h, i, w in rows if h == g]
        want = sainte_lague([w for _, w in mine], [10**6] * len(mine), seats[g] if any(w for _, w in mine) else 0)
        assert [got.get((g, i), 0) for i, _ in mine] == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets(spark, seed):
    rng = random.Random(seed)
    names = sorted(["a", "B", "é", "z", "src10", "src2", "漢", "ａ"]) + [None]
    sizes = [rng.choice([0, 1, 10, 500, 90_000]) for _ in names]
    df = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long").repartition(3)
    got = {r["source"]: (r["weight"], r["target"]) for r in mixing.targets(df).collect()}
    weights = [i % 3 + 1 for i in range(len(names))]
    assert [got[n][0] for n in names] == weights
    assert [got[n][1] for n in names] == pytest.approx(fill(sizes, weights))


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["a", "b", "c", None])
        rows.append((i, rng.choice(["", "x " * rng.randint(1, 300), "y\n" * rng.randint(1, 20)]), source, "s"))
    return rows + [(n, None, "a", "s"), (None, "w w w", "only", "s"), (1, rows[1][1], rows[1][2], "s"), (n + 1, "", "empty", "s")]


def test_mix(spark):
    rows = made(4, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(5)
    found = mixing.mix(docs, shard_words=5_000, shard_rows=100)
    taken = found.taken.collect()
    assert len(taken) == len(rows)
    again = mixing.mix(docs.repartition(2), shard_words=5_000, shard_rows=100).taken.collect()
    assert sorted(map(tuple, taken), key=repr) == sorted(map(tuple, again), key=repr)
    sums = {}
    for r in taken:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] + r["part"]
        got = sums.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        got[0] += r["taken"]
        got[1] += r["size"]
    block = found.sources.first()["block"]
    for got, size, target, source_size in sums.values():
        assert size == source_size and abs(got - target) <= max(2 * block, 0.01 * target)
    assert sum(t for _, _, t, _ in sums.values()) == pytest.approx(sum(s for _, s, _, _ in sums.values()))

    mixed = mixing.mixed_documents(docs, found)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert words == {s: got for s, (got, *_) in sums.items() if got}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).taken.collect() == []
    nothing = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(nothing).taken.collect()] == [0, 0]
