import random
import re

import pytest

from kbcurate.llm import graph, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    s = [(i, sets(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, (i, a) in enumerate(s):
        for j, b in s[:p]:
            if None not in (i, j) and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    out = []
    for i, a in s:
        c = None if i is None else find(i)
        out.append((i, len(a), c, True if i is None else c == i))
    return sorted(out, key=repr)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, kept int")
    return sorted((tuple(r) for r in minhash.near_duplicates(docs.repartition(3)).collect()), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
    return words


def made(seed, families, size, edits):
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 50)) for _ in range(rng.randint(1, 150))]
        last = base
        for _ in range(rng.randint(1, size)):
            last = edited(rng, rng.choice([base, last]), rng.randint(0, edits))
            rows.append(" ".join(last) if rng.random() < 0.9 else " ".join(last).upper())
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_agrees_with_brute_force(spark):
    rows = made(3, 40, 12, 4)
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (None, rows[0][1]), (n + 3, "one two"), (n + 4, "One TWO"),
             (n + 5, "x " * 5000), (n + 6, "X\t" * 4000), (7, rows[7][1])]
    assert run(spark, rows) == brute(rows)


def test_large_groups_are_cut_without_losing_links(spark, monkeypatch):
    for name, value in (("CHUNK", 16), ("BUCKET", 24), ("PIVOTS", 2)):
        monkeypatch.setattr(minhash, name, value)
    rows = made(9, 3, 120, 3) + []
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    links += [(200, i) for i in range(201, 260)] + [(5, 5), (None, 3)]
    got = {r[0]: r[1] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for e in links for x in e if x is not None}
    for _ in range(70):
        for a, b in links:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert got == {x: label[x] for x in linked}
