"""Words of whole texts as arrays of 64-bit hashes, a batch of documents at a time.

A word is a maximal run of characters other than ``\\x20`` and ``\\x09``-``\\x0D``. Batches are
concatenated: ``words.hash[words.start[i]:words.start[i + 1]]`` are the words of document ``i``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once in a worker; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Words:
    start: np.ndarray  # int64, one more than documents
    hash: np.ndarray  # uint64 per word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.start)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``size`` bytes of text, so that a worker's memory
    is bounded by that or by its longest text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Starts per document and the flat array of its words; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    kept = full.to_numpy(zero_copy_only=False)
    if not kept.all():
        before = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])
        flat = flat.filter(full)
        base = offsets[0]
        offsets = before[offsets - base]
    return offsets - offsets[0], flat


def encode(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Index of each word in the array of distinct words."""
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hash_words(texts: pa.Array, lower: bool = False) -> Words:
    """64-bit hash of every word; ``lower`` maps A-Z to a-z first, and nothing else."""
    if lower:
        texts = pc.ascii_lower(texts)
    start, flat = split_words(texts)
    if len(flat) == 0:
        return Words(start, np.zeros(0, np.uint64))
    index, distinct = encode(flat)
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter(
        (digest(w) for w in distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct)
    )
    return Words(start, table[index])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of a well-known public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hash of any span of a word array in constant time, from prefix sums modulo 2**64.

    A span's hash depends on its words and their order only, not on its place.
    """

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        up = np.full(n, _ODD, np.uint64)
        if n:
            up[0] = 1
        up = np.multiply.accumulate(up) if n else up
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        down = np.full(n + 1, inverse, np.uint64)
        down[0] = 1
        self.down = np.multiply.accumulate(down)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans ``[start, end)``; the length is part of the hash."""
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_starts(start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Global start and document of every window of ``size`` words that lies in one document."""
    counts = np.maximum(np.diff(start) - size + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return start[:-1][doc] + np.arange(len(doc)) - first[doc], doc


def sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every run of ``size`` values, by doubling."""
    out, width = values, 1
    while width * 2 <= size:
        out = best(out[: len(out) - width], out[width:])
        width *= 2
    rest = size - width
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def to_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
