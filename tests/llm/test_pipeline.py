import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from kbcurate.llm import minhash, substring

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    names = docs.columns
    stage = {n: f for n, f in corpus_pipeline.STAGES}
    assert list(stage) == ["quality classifier", "MinHash near-dedup", "substring dedup", "mixing sources", "packing"]
    steps = [docs]
    for _, f in corpus_pipeline.STAGES:
        out = f(spark, steps[-1], FOLDER)
        steps.append(spark.createDataFrame(out.collect(), out.schema).cache())
    assert all(s.columns == names for s in steps[:-1])
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    assert ids[1] <= ids[0] and ids[2] <= ids[1] and ids[3] == ids[2] and ids[4] <= ids[3] and ids[5] == ids[4]

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    clean = {r.doc_id for r in labels if r.quality == 1}
    assert len(clean - ids[1]) <= 0.02 * len(clean)
    assert ids[2] == {r.id for r in minhash.near_duplicates(steps[1]).where("kept").collect()}

    cut = {r.doc_id: r for r in steps[3].collect()}
    told = substring.remove_repeats(steps[2]).selectExpr("row.doc_id", "n_words - n_removed AS left").collect()
    assert {r.doc_id: r.left for r in told} == {i: len(WORD.findall(r.text or "")) for i, r in cut.items()}
    assert all(r.n_chars == len(r.text) for r in cut.values() if r.text is not None)

    total = sum(len(WORD.findall(r.text or "")) for r in cut.values())
    mixed = steps[4].collect()
    assert abs(sum(len(WORD.findall(r.text)) for r in mixed) - total) <= 0.02 * total
    times = {}
    for r in mixed:
        times[r.doc_id] = times.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert all(n <= 3 * len(WORD.findall(cut[i].text)) for i, n in times.items())

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(zlib.crc32(np.array(plain.encode(r.text, add_special_tokens=False).ids + [1], "<u4")[:2048].tobytes()) for r in mixed)
    pieces = steps[5].collect()
    assert sorted(r.ids_crc32 for r in pieces if r.start == 0) == want


def test_defined_results_on_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    text = " ".join(rng.choice(["the", "of", "and", "er"]) for _ in range(80))
    rows = [(1, text, "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (None, text, "en", "b", 1), (1, text, "en", "a", 1)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, kind).write.parquet(f"{folder}/documents.parquet")
    labels = "doc_id long, quality int, toxic int"
    spark.createDataFrame([(1, 1, 0)], labels).write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() > 0
    empty = f"{folder}/empty"
    spark.createDataFrame([], kind).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], labels).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_extra_columns_with_clashing_names(spark, tmp_path):
    """Columns named like those the stages make pass through every stage but the last."""
    names = ["text_key", "id2", "_take", "_key", "_copies", "_parts", "_rows", "_id", "row", "spans", "id", "component", "keep", "n"]
    rng = random.Random(3)
    words = ["the", "of", "and", "er", "in"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(70)), "en", f"s{i % 2}", 1, *[f"{c}{i}" for c in names]) for i in range(12)]
    rows.append((None, None, None, None, None, *[None] * len(names)))
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame(rows, kind)
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if at < 4:
            assert out.columns == docs.columns, name
            for r in out.collect():
                if r.doc_id is not None:
                    assert [r[c] for c in names] == [f"{c}{r.doc_id}" for c in names], name
        path = f"{folder}/{at}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() > 0
