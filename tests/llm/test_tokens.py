import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kbcurate.llm import codec, counts, packing, tokenfile, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "The", "thea", "don't", "'s", "É", "élan", "İ", "ß", " ", "  ", "\n", "\t", "\x0b", " ", "　", "1", "42",
        "...", ".", ",", "!!", "a.b", "<|endoftext|>", "<|ENDOFTEXT|>", "<s>", "</w>", "▁", "▁▁", "é", "한", "各", "漢字",
        "🙂", "ŉ", "K", "\x00", "́", "x́", "word", "Word.", "naïve,"]


def texts(seed, n):
    rng = random.Random(seed)
    made = ["".join(rng.choice(BITS) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return made + [None, "", " ", "\n", "word " * 3000, "a" * 3000, "end "]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_word_ids_are_the_library_s(seed, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    mine, plain = tokens.WordIds(WORDS), Tokenizer.from_file(WORDS)
    for group in (texts(seed, 150), [t for t in texts(seed, 150) if "<|" not in (t or "")]):
        for cut in (slice(0, 70), slice(70, None)):
            bounds, ids = mine.encode(pa.array(group, pa.string())[cut], 1)
            want = [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in group[cut]]
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_piece_counts_are_the_library_s(seed, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    mine = tokens.PieceCounts(PIECES, np.zeros(0, np.uint64), np.zeros(0, np.int32))
    group = texts(seed, 150)
    assert mine.count(pa.array(group, pa.string())).tolist() == [len(model.encode(t or "")) for t in group]


def test_counts_query(spark):
    group = texts(7, 80)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(group)] + [(None, "x y", 1)], "doc_id long, text string, n_tokens int")
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted((tuple(r) for r in counts.token_counts(docs, PIECES, limit=50, table=20).collect()), key=repr)
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 50) for i, t in enumerate(group)] + [(None, 3, 2, False)]
    assert got == sorted(want, key=repr)
    assert counts.token_counts(docs.limit(0), PIECES).collect() == []


def test_files_round_trip(spark, tmp_path):
    group = texts(9, 120)
    rows = [(i * 3, t, "x") for i, t in enumerate(group)] + [(6, "twice", "x")]
    rows += [(None, "no id", "x"), (None, None, "x"), (None, "no id", "x"), (1, "word " * 40_000, "x")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(4)
    files = tokenfile.write_tokens(docs, f"file://{tmp_path}", WORDS, parts=5, file_tokens=300)
    files = spark.createDataFrame(files.collect(), files.schema)
    assert files.count() >= 5 and not list(tmp_path.glob("_*"))
    got = tokenfile.read_tokens(spark, f"file://{tmp_path}", files).collect()
    plain, at = Tokenizer.from_file(WORDS), 0
    kept = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(kept)
    by_start = sorted(got, key=lambda r: r["start"])
    for r, nxt in zip(by_start, [*by_start[1:], None]):
        assert r["start"] == at and zlib.crc32(r["ids"]) == r["ids_crc32"]
        at += r["n_tokens"]
    assert [r["id"] for r in by_start] == [r[0] for r in kept]
    want = sorted(((i, tuple(plain.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, _ in kept), key=repr)
    assert sorted(((r["id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got), key=repr) == want
    broken = next(tmp_path.glob("*.tok"))
    data = bytearray(broken.read_bytes())
    data[40] ^= 255
    with pytest.raises(codec.CorruptBlock):
        list(tokenfile.file_documents(bytes(data)))


def test_a_partition_written_twice_is_read_once(spark, tmp_path):
    """The second run of a task leaves files beside those of the first; the plan names one of them."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string").repartition(2)
    plan = tokenfile.write_tokens(docs, f"file://{tmp_path}", WORDS, parts=3)
    plan.collect()
    second = spark.createDataFrame(plan.collect(), plan.schema)
    assert len(list(tmp_path.glob("*.tok"))) == 2 * second.count()
    got = tokenfile.read_tokens(spark, f"file://{tmp_path}", second).collect()
    assert sorted(r["id"] for r in got) == list(range(40))


def test_no_documents_no_files(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    files = tokenfile.write_tokens(docs, f"file://{tmp_path}", WORDS, parts=2)
    assert files.collect() == []


def test_shortest_pack_first():
    rng = random.Random(4)
    for _ in range(60):
        size = rng.randint(1, 60)
        histogram = {n: rng.choice([0, 1, 2, 5, 1000]) for n in range(1, size + 1)}
        patterns = packing.shortest_pack_first(histogram, size)
        used = dict.fromkeys(histogram, 0)
        for pattern, count in patterns:
            assert count > 0 and sum(pattern) <= size
            for n in pattern:
                used[n] += count
        assert used == histogram
    assert packing.shortest_pack_first({6: 1, 5: 1, 4: 1, 2: 1}, 10) == [((5, 4), 1), ((6, 2), 1)]


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    group = texts(5, 150) + [None] * 60
    rows = [(i, t, "x") for i, t in enumerate(group)] + [(3, group[3], "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(3)
    got = packing.pack(docs, WORDS, size=64, keep_ids=True).collect()
    plain = Tokenizer.from_file(WORDS)
    want = sorted(tuple(plain.encode(t or "", add_special_tokens=False).ids + [1]) for _, t, _ in rows)
    whole, by_sequence = {}, {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        whole.setdefault((r["id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(map(len, want))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    single = [b"".join(x for _, x in sorted(v)) for k, v in whole.items() if k[0] != 3]
    assert len(single) == len(group)
    texts_of = sorted(tuple(np.frombuffer(x, "<u4").tolist()) for x in single)
    assert texts_of == sorted(tuple(plain.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _ in rows if i != 3)
    assert packing.pack(docs.limit(0), WORDS).collect() == []
