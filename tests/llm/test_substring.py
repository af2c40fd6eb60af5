import hashlib
import random
import re

import pytest

from kbcurate.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s:s + window])] < i:
                gone.update(range(s, s + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, window, anchor):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string")
    out = substring.remove_repeats(docs.repartition(3), window=window, anchor=anchor)
    out = out.select("row.doc_id", "n_words", "n_removed", substring.kept_sha256(out["kept_text"]).alias("h"))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def made(seed, n):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 30))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            own = [rng.choice("ijklmnop") for _ in range(rng.randint(0, 12))]
            parts += [rng.choice(pool), rng.choice([" ", "\n", "\t  "]).join(own)]
        rows.append((i, " ".join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "x " * 200), (n + 3, "x " * 90), (None, rows[2][1]), (5, rows[5][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_brute_force(spark, seed):
    rows = made(seed, 60)
    assert run(spark, rows, 10, 3) == brute(rows, 10)


def test_production_window_and_shared_passage(spark):
    rng = random.Random(5)
    passage = [rng.choice("qrstuvwxyz") + str(rng.randint(0, 99)) for _ in range(60)]
    rows = []
    for i in range(80):
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 90))]
        cut = rng.randint(0, len(own))
        changed = list(passage)
        if i % 3 == 0:
            changed[rng.randint(0, 59)] = "edited"
        rows.append((i, " ".join(own[:cut] + changed + own[cut:])))
    assert run(spark, rows, 50, 12) == brute(rows, 50)


def test_empty_table(spark):
    assert run(spark, [], 50, 12) == []
