import math
import random
from collections import Counter, defaultdict

import pytest

from kbcurate.llm import quality

ORDER = 3


def brute_model(texts, order):
    """Plain dictionaries of one language: p(gram) and backoff(context)."""
    counts = Counter()
    for t in texts:
        s = quality.START * (order - 1) + t + quality.END
        counts.update(s[i - order + 1:i + 1] for i in range(order - 1, len(s)))
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    p, backoff, lower = {}, {}, None
    for k in range(1, order + 1):
        c = tables[k]
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
        d = []
        for i, default in ((1, 0.5), (2, 1.0), (3, 1.5)):
            exact = i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0
            d.append(exact if n[1] and n[i] and 0 < exact < i else default)
        total, taken, size = defaultdict(int), defaultdict(float), Counter()
        for g, x in c.items():
            total[g[:-1]] += x
            taken[g[:-1]] += d[min(x, 3) - 1]
            size[g[:-1]] += 1
        for h in total:
            backoff[k, h] = taken[h] / total[h]
        for g, x in c.items():
            below = p[k - 1, g[1:]] if k > 1 else 1 / (size[""] + 1)
            p[k, g] = (x - d[min(x, 3) - 1]) / total[g[:-1]] + backoff[k, g[:-1]] * below
    unknown = backoff[1, ""] / (len(tables[1]) + 1)

    def logp(text):
        s, out = quality.START * (order - 1) + text + quality.END, 0.0
        for i in range(order - 1, len(s)):
            for k in range(order, 0, -1):
                g = s[i - k + 1:i + 1]
                if (k, g) in p:
                    out += math.log(p[k, g])
                    break
                if k == 1:
                    out += math.log(unknown)
                elif (k, g[:-1]) in backoff:
                    out += math.log(backoff[k, g[:-1]])
        return out

    return logp


def made(seed, n):
    rng = random.Random(seed)
    parts = {"en": ["the ", "of ", "and ", "ing ", "er", "th", "at"], "fr": ["le ", "é", "ou", "ç ", "aux "], None: ["漢", "字 ", "🙂"]}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "fr", None])
        rows.append((i, "".join(rng.choice(parts[lang]) for _ in range(rng.randint(0, 60))), lang))
    return rows


@pytest.mark.parametrize("shard_rows", [10**6, 40])
def test_model_agrees_with_dictionaries(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(quality, "SHARD_ROWS", shard_rows)
    rows = made(1, 90)
    trusted = [r for r in rows if r[0] % 2]
    tested = rows + [(500, None, "en"), (501, "", "fr"), (502, "Zq the of", "en"), (503, "unseen", "de"), (None, "the", "en")]
    kind = "doc_id long, text string, lang string"
    df = spark.createDataFrame(tested, kind).fillna("", ["lang"]).repartition(3)
    model = quality.train(spark.createDataFrame(trusted, kind).fillna("", ["lang"]).repartition(3), order=ORDER)
    assert (model.shards > 1) == (shard_rows == 40)
    got = {r["id"]: r for r in quality.scores(df, model).collect()}
    plain = {lang: brute_model([t for _, t, x in trusted if x == lang], ORDER) for lang in ("en", "fr", None)}
    assert len(got) == len(tested)
    for i, text, lang in tested:
        assert got[i]["n"] == len(text or "") + 1
        if lang in plain:
            assert got[i]["logp"] == pytest.approx(plain[lang](text or ""), rel=1e-9)
        else:
            assert got[i]["logp"] is None


def test_classify_the_labelled_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    trusted = labels.where("quality = 1 AND toxic = 0 AND doc_id % 2 = 0").selectExpr("doc_id AS id")
    out = quality.classify(docs.withColumn("keep", docs["lang"]), trusted)
    assert out.count() == docs.count()
    held = out.join(labels.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "id"), "id")
    rates = {r["quality"]: r["kept"] for r in held.groupBy("quality").agg({"keep": "count"}).join(
        held.where("keep").groupBy("quality").count(), "quality", "left"
    ).selectExpr("quality", "coalesce(`count`, 0) / `count(keep)` AS kept").collect()}
    assert rates[1] > 0.99 and rates[0] < 0.3


def test_nothing_trusted_and_nothing_at_all(spark):
    kind = "doc_id long, text string, lang string"
    none = spark.createDataFrame([], "id long")
    assert [r["keep"] for r in quality.classify(spark.createDataFrame([(1, "x", "en")], kind), none).collect()] == [True]
    assert quality.classify(spark.createDataFrame([], kind), none).collect() == []


def test_words_repeated_in_a_row_go(spark):
    """Trained on even labelled documents, judged on the others: junk that repeats its words, and all junk."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    trusted = labels.where("quality = 1 AND toxic = 0 AND doc_id % 2 = 0").selectExpr("doc_id AS id")
    held = docs.join(labels.where("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id")
    rows = quality.classify(docs, trusted).join(held.selectExpr("doc_id AS id", "quality", "text"), "id").collect()

    def repeats(text):
        words = text.split()
        return sum(a == b for a, b in zip(words, words[1:])) > 0.3 * max(1, len(words) - 1)

    bad = [r["keep"] for r in rows if r["quality"] == 0]
    again = [r["keep"] for r in rows if r["quality"] == 0 and repeats(r["text"])]
    good = [r["keep"] for r in rows if r["quality"] == 1]
    print(sum(bad), len(bad), sum(again), len(again), sum(good), len(good))
    assert len(again) > 50 and sum(again) < 0.1 * len(again)
    assert sum(bad) < 0.05 * len(bad) and sum(good) > 0.99 * len(good)


def test_one_trusted_document_has_a_threshold(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en")], "doc_id long, text string, lang string")
    row = quality.classify(docs, spark.createDataFrame([(1,)], "id long")).collect()[0]
    assert row["threshold"] is not None and row["keep"]


def test_loops_of_words_and_sentences_go(spark):
    """A pair of words, five words, or twenty words of a good text said 20 to 200 times, in each language:
    trained on even labelled documents, the loops made of odd ones; good odd documents stay."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    trusted = labels.where("quality = 1 AND toxic = 0 AND doc_id % 2 = 0").selectExpr("doc_id AS id")
    good = docs.join(labels.where("quality = 1 AND toxic = 0 AND doc_id % 2 = 1").select("doc_id"), "doc_id")
    made, rng = [], random.Random(8)
    for lang in sorted({r["lang"] for r in good.select("lang").distinct().collect()}):
        texts = [r["text"].split() for r in good.where(good["lang"] == lang).orderBy("doc_id").limit(60).collect()]
        texts = [t for t in texts if len(t) >= 25]
        for size in (2, 5, 20):
            for _ in range(20):
                words = rng.choice(texts)
                at = rng.randrange(len(words) - size)
                made.append((-1 - len(made), lang, size, " ".join(words[at:at + size] * rng.randint(20, 200))))
    loops = spark.createDataFrame(made, "doc_id long, lang string, size int, text string")
    every = docs.select("doc_id", "lang", "text").unionByName(loops.select("doc_id", "lang", "text"))
    kept = {r["id"]: r["keep"] for r in quality.classify(every, trusted).collect()}
    share = {n: [kept[i] for i, _, size, _ in made if size == n] for n in (2, 5, 20)}
    fine = [kept[r["doc_id"]] for r in good.select("doc_id").collect()]
    print({n: (sum(x), len(x)) for n, x in share.items()}, sum(fine), len(fine))
    every = sum(share.values(), [])
    assert sum(every) <= 0.1 * len(every) and all(sum(x) <= 0.2 * len(x) for x in share.values())
    assert sum(fine) >= 0.99 * len(fine)


def test_repeats():
    import pyarrow as pa

    pairs, repeats = quality._repeats(pa.array(["a a b", None, "", "x", "a b c d e a b c d f", "p q " * 5, "a b c d", "a b c d"]))
    assert pairs.tolist() == [2, 0, 0, 0, 9, 9, 3, 3]
    assert repeats.tolist() == [1, 0, 0, 0, 1, 5, 0, 0]


def test_ties_repeated_rows_and_a_very_long_text(spark):
    rows = [(1, "the cat sat on the mat", "en"), (1, "the cat sat on the mat", "en"), (2, "the cat sat on the mat", "en"),
            (3, "the dog sat on the cat " * 30_000, "en"), (None, "the cat sat on the mat", "en"), (4, "the cat sat", None)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, cost string")
    got = quality.classify(docs, spark.createDataFrame([(1,), (2,), (1,), (None,)], "id long")).collect()
    assert len(got) == len(rows)
    same = {(r["cost"], r["threshold"], r["keep"]) for r in got if r["n_chars"] == 23}
    assert len(same) == 1 and same.pop()[2]  # equal texts at the threshold stay together
    assert [r["keep"] for r in got if r["lang"] == ""] == [True]
    assert [r["keep"] for r in got if r["id"] == 3] == [False]
