import random
import re

from kbcurate.llm import licences

NOTICE = "Licensed under the Apache License, Version 2.0."


def grams(text):
    words = re.sub(r"[^a-z0-9à-ÿ]+", " ", text.lower()).split()
    return {(a, b) for a, b in zip(words, words[1:])}


def brute(text):
    lines = (text or "").split("\n")
    hits, n = [], 0
    for segment in lines + ([" ".join(lines)] if len(lines) > 1 else []):
        g = grams(segment)
        scores = []
        for at, name in enumerate(n for n in sorted(licences.TEMPLATES) for _ in licences.TEMPLATES[n]):
            t = grams([x for n in sorted(licences.TEMPLATES) for x in licences.TEMPLATES[n]][at])
            if g:
                scores.append((-2 * len(g & t) / (len(g) + len(t)), at, name))
        best = min(scores, default=(0, 0, None))
        if -best[0] >= licences.THRESHOLD:
            hits.append(best)
            n += 1
    top = min(hits, default=(0.0, 0, None))
    return top[2], -top[0] + 0.0, n


def test_scan(spark):
    mit = licences.TEMPLATES["MIT"][1]
    rows = [
        NOTICE, f"some prose here\n{NOTICE}\nmore prose", NOTICE.upper().replace(" ", "  \t"), "licensed under apache version 2",
        mit, "\n".join(re.findall(r".{1,70}(?: |$)", mit)), mit.replace("software", "program"), f"{NOTICE} {NOTICE}",
        f"{NOTICE}\nReleased under the MIT License.", "Released under the MIT License, see below.", "x y " * 20_000, "a", "", None, "\n\n", "É è",
        "This work is licensed under the GNU General Public License, version 3.",
    ]
    docs = spark.createDataFrame(
        [(i, t, 1) for i, t in enumerate(rows)] + [(None, NOTICE, 1), (0, NOTICE, 1)], "doc_id long, text string, score int"
    )
    got = sorted((tuple(r) for r in licences.scan(docs).collect()), key=repr)
    want = [(i, *brute(t)) for i, t in enumerate(rows)] + [(None, *brute(NOTICE)), (0, *brute(NOTICE))]
    assert got == sorted(want, key=repr)
    assert brute(NOTICE)[0] == "Apache-2.0" and brute(rows[5])[0] == "MIT" and brute(rows[3])[0] is None
    assert licences.scan(docs.limit(0)).collect() == []


def test_passages_inside_longer_text(spark):
    mit, apache = licences.TEMPLATES["MIT"][1], licences.TEMPLATES["Apache-2.0"][1]
    prose = " ".join(f"plain{i} words{i} of" for i in range(150)) + " "
    wrapped = ["\n".join(re.findall(r".{1,70}(?: |$)", x)) for x in (mit, apache)]
    rows = [
        (f"{prose}\n{wrapped[0]}\n{prose}", "MIT", 1.0, 1),
        (f"{prose}\n# {wrapped[1]}\n{prose}", "Apache-2.0", None, None),
        (f"{prose}{mit} {prose}", "MIT", 1.0, 1),
        ("This library is released under the MIT License.", "MIT", 1.0, 1),
        ("Copyright 2020 Jane Doe. Released under the MIT License.", "MIT", 1.0, 1),
        ("See LICENSE for terms. All rights reserved.", "Proprietary", 1.0, 1),
        (f"{prose} Released under the MIT License. {prose} {NOTICE} {prose}", "Apache-2.0", 1.0, 2),
        (prose, None, 0.0, 0),
        ("a license was released under all of the rights of mit", None, 0.0, 0),
    ]
    docs = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = {r["id"]: (r["licence"], r["score"], r["n_segments"]) for r in licences.scan(docs).collect()}
    for i, (_, licence, score, n) in enumerate(rows):
        assert got[i][0] == licence, (i, got[i])
        assert score is None or got[i][1:] == (score, n), (i, got[i])


def brute_whole(text):
    """Segments as in ``brute``, then passages in what is left of a text that is no licence itself."""
    rows = licences.template_rows()
    score_of = lambda c, d, n: 2.0 * c / (d + n)
    squeeze = lambda x: " ".join(re.sub(r"[^a-z0-9à-ÿ]+", " ", x.lower()).split())
    pairs = lambda x: [f"{a} {b}" for a, b in zip(x.split(), x.split()[1:])]

    def best(segment):
        g = set(pairs(segment))
        found = [(score_of(len(g & set(t)), len(g), len(t)), -at) for at, _, t, low, high in rows if low <= len(g) <= high]
        return max((f for f in found if f[0] >= licences.THRESHOLD), default=None)

    lines = [squeeze(x) for x in (text or "").split("\n")]
    judged = [best(x) for x in lines]
    whole = best(" ".join(" ".join(lines).split())) if len(lines) > 1 else None
    hits, n = [b for b in [*judged, whole] if b], sum(b is not None for b in [*judged, whole])
    if not (whole or (len(lines) == 1 and judged[0])):
        g = pairs(" ".join(x for x, b in zip(lines, judged) if b is None))
        windows = []
        for at, _, t, least, most in rows:
            t = set(t)
            if len(t & set(g)) < least:
                continue
            for s in (i for i, x in enumerate(g) if x in t):
                seen, c, top, end = set(), 0, 0.0, 0
                for q in range(s, min(s + most, len(g))):
                    c += g[q] in t and g[q] not in seen
                    seen.add(g[q])
                    if score_of(c, len(seen), len(t)) > top:
                        top, end = score_of(c, len(seen), len(t)), q
                if top >= licences.THRESHOLD:
                    windows.append((s, end, top, -at))
        last = -1
        for s, end, top, at in sorted(windows):
            n += s > last
            last = max(last, end)
            hits.append((top, at))
    top = max(hits, default=None)
    names = {at: name for at, name, *_ in rows}
    return (names[-top[1]], top[0], n) if top else (None, 0.0, 0)


def test_random_texts_with_planted_passages(spark):
    rng = random.Random(3)
    texts = [x for name in sorted(licences.TEMPLATES) for x in licences.TEMPLATES[name]]
    vocabulary = [w for t in texts for w in t.split()] + [f"w{i}" for i in range(300)]
    rows = []
    for i in range(250):
        parts = []
        for _ in range(rng.randint(1, 7)):
            kind = rng.random()
            if kind < 0.4:
                parts.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))))
            elif kind < 0.9:
                words = [w if rng.random() > 0.05 else rng.choice(vocabulary) for w in rng.choice(texts).split()]
                parts.append(" ".join(words).replace(" ", rng.choice([" ", "\n"]), rng.choice([0, 3, 99])))
            else:
                parts.append("")
        rows.append((i, rng.choice(["\n", " ", "\n\n"]).join(parts)))
    rows += [(None, rows[0][1]), (1, rows[1][1]), (1, None), (500, "prose " * 30_000 + texts[0] + " prose" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = sorted((tuple(r) for r in licences.scan(docs).collect()), key=repr)
    assert got == sorted(((i, *brute_whole(t)) for i, t in rows), key=repr)
    assert sum(r[1] is not None for r in got) > 150
