import numpy as np
import pyarrow as pa

from kbcurate.llm.words import Rolling, hash_words, sliding, split_words, window_starts


def test_words_are_runs_outside_six_characters():
    texts = pa.array(["a b", None, "", " x\ty\n\x0bz\x0c\r ", "e f g　"])
    start, flat = split_words(texts)
    assert start.tolist() == [0, 2, 2, 2, 5, 7]
    assert flat.to_pylist() == ["a", "b", "x", "y", "z", "e f", "g　"]
    sliced = split_words(texts.slice(3, 2))
    assert sliced[0].tolist() == [0, 3, 5] and sliced[1].to_pylist() == flat.to_pylist()[2:]


def test_lower_maps_ascii_only():
    a, b = hash_words(pa.array(["ÀB", "Àb"]), lower=True).hash, hash_words(pa.array(["àb"])).hash
    assert a[0] == a[1] and a[0] != b[0]


def test_span_hashes_depend_on_content_and_length():
    h = hash_words(pa.array(["a b c a b c a b", "a b c"])).hash
    spans = Rolling(h).spans(np.array([0, 3, 8, 1, 0]), np.array([3, 6, 11, 4, 2]))
    assert spans[0] == spans[1] == spans[2] and len({*spans.tolist()}) == 3


def test_sliding_and_windows():
    v = np.array([5, 1, 4, 2, 8, 3, 9])
    for n in range(1, 8):
        assert sliding(v, n, np.minimum).tolist() == [min(v[i:i + n]) for i in range(len(v) - n + 1)]
    start, doc = window_starts(np.array([0, 3, 4, 4, 8]), 3)
    assert start.tolist() == [0, 4, 5] and doc.tolist() == [0, 3, 3]
