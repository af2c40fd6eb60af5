import numpy as np
import pytest

from kbcurate.llm import codec

V = 49_408


def trip(ids, v=V):
    data = codec.encode_block(np.asarray(ids, np.uint32), v)
    back, end = codec.decode_block(memoryview(data), 0, v)
    assert end == len(data) and back.tolist() == list(ids)
    return len(data)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 129, 1000, 4097, 70_001])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    trip(rng.integers(0, V, n))
    trip((rng.zipf(1.3, n) - 1) % V)
    trip(np.full(n, V - 1))


def test_random_small_blocks_hit_carries():
    rng = np.random.default_rng(1)
    for _ in range(150):
        v = int(rng.integers(2, 400))
        trip(rng.integers(0, v, int(rng.integers(1, 300))), v)


def test_repeats_and_frequent_ids_take_less_room():
    rng = np.random.default_rng(2)
    flat = trip(rng.integers(0, V, 60_000))
    zipf = trip((rng.zipf(1.5, 60_000) - 1) % V)
    pattern = trip(np.tile(rng.integers(0, V, 50), 1200))
    assert pattern < zipf < flat < 60_000 * 2.3


def test_damage_is_found():
    data = bytearray(codec.encode_block(np.arange(1000, dtype=np.uint32), V))
    data[500] ^= 1
    with pytest.raises(codec.CorruptBlock):
        codec.decode_block(memoryview(bytes(data)), 0, V)
    with pytest.raises(codec.CorruptBlock):
        codec.decode_block(memoryview(bytes(data[:-3])), 0, V)
