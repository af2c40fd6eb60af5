"""Token ids and counts of whole texts in workers: distinct words are encoded once per slice."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from kbcurate.llm.words import encode, split_words

#: Words a worker remembers, about 40 bytes each; when full, it starts anew.
CACHE_WORDS = 800_000


#: Letters that lower to one letter and stand alone under NFC, so that a run of them is one word
#: of the tokenizer; and marks that end a word wherever they follow a letter.
_LETTER = "[a-zA-ZÀ-ÖØ-Þß-öø-ÿ]"
_PLAIN = f"^{_LETTER}+$"
_CUT = f"({_LETTER})([.,!?;:])"


class WordIds:
    """Ids of texts under a ``tokenizers`` file whose tokens never span white space.

    Such a tokenizer gives for a text the ids of its words (runs without ASCII white space) in
    order. So each distinct word of a slice is encoded once, or taken from the worker's cache.
    Marks after a letter are set apart and ASCII lower-cased first, which changes no id as the
    tokenizer does both itself; texts with special strings (``<|``) are left as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._keep(pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _keep(self, words: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        """The known words with the ids of all of them in a row."""
        self.words, self.sizes, self.ids = words, sizes, ids

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of new words, and all ids in the order of the words."""
        sizes = np.zeros(len(words), np.int64)
        parts = []
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        alone = [np.flatnonzero(~plain)]
        joint = np.flatnonzero(plain)
        chunks = [joint[at:at + 2000] for at in range(0, len(joint), 2000)]
        texts = [" ".join(words.take(pa.array(c)).to_pylist()) for c in chunks]
        for at, found in zip(chunks, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(at):
                sizes[at] = np.diff(cuts, prepend=0)
                parts.append((at, ids))
            else:
                alone.append(at)
        alone = np.concatenate(alone)
        for at in range(0, len(alone), 20_000):
            some = alone[at:at + 20_000]
            found = self.tokenizer.encode_batch_fast(words.take(pa.array(some)).to_pylist(), add_special_tokens=False)
            sizes[some] = [len(x.ids) for x in found]
            parts.append((some, np.array([i for x in found for i in x.ids], np.uint32)))
        ids = np.empty(int(sizes.sum()), np.uint32)
        first = np.cumsum(sizes) - sizes
        for at, mine in parts:
            ids[_spread(first[at], sizes[at])] = mine
        return sizes, ids

    def _of_words(self, words: pa.Array) -> np.ndarray:
        """Places of words among the known ones, which new ones join. When they are too many, only
        those of this call stay."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        place = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self.words) + len(new) > CACHE_WORDS:
            held = place[place >= 0]
            first = np.cumsum(self.sizes) - self.sizes
            ids = self.ids[_spread(first[held], self.sizes[held])]
            self._keep(self.words.take(pa.array(held)), self.sizes[held], ids)
            place[place >= 0] = np.arange(len(held))
        if len(new):
            place[place < 0] = len(self.words) + np.arange(len(new))
            sizes, ids = self._learn(new)
            self._keep(pa.concat_arrays([self.words, new]), np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids]))
        return place

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds per document and all ids, each document closed by ``end_id``."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=_CUT, replacement=r"\1 \2")
        start, flat = split_words(texts)
        docs = len(start) - 1
        if not len(flat):
            return np.arange(docs + 1), np.full(docs, end_id, np.uint32)
        index, distinct = encode(flat)
        place = self._of_words(distinct.cast(pa.large_string()))[index]
        first = np.cumsum(self.sizes) - self.sizes
        count = self.sizes[place]
        ends = np.concatenate([[0], np.cumsum(count)])
        bounds = ends[start] + np.arange(docs + 1)
        ids = np.full(bounds[-1], end_id, np.uint32)
        held = np.ones(bounds[-1], bool)
        held[bounds[1:] - 1] = False
        ids[held] = self.ids[_spread(first[place], count)]
        return bounds, ids


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, as many as its size, in a row."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(first - before, sizes) + np.arange(int(sizes.sum()))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The encoder of a worker process, whose cache serves task after task."""
    return WordIds(path)


class PieceCounts:
    """Numbers of pieces of texts under a ``sentencepiece`` model that keeps texts as they are, adds
    one space in front, and has no piece with a space after another character.

    Under such a model pieces never span the place before a run of spaces, so a text's number of
    pieces is the sum over its pre-tokens, each a run of spaces with what follows. ``hashes`` and
    ``lengths`` are the table of frequent pre-tokens; the others are counted through the worker's
    cache. A pre-token of the table is known by its 64-bit hash.
    """

    def __init__(self, path: str, hashes: np.ndarray, lengths: np.ndarray):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.hashes, self.lengths = hashes, lengths
        self.cache: dict[str, int] = {}

    def of_words(self, words: list[str]) -> np.ndarray:
        """Pieces of each word with one space in front."""
        cache = self.cache
        new = [w for w in words if w not in cache]
        if len(cache) + len(new) > CACHE_WORDS:
            self.cache = cache = {w: cache[w] for w in words if w in cache}
        if new:
            # an empty word is a lone space in front of the end or of nothing else
            found = self.model.encode(new, num_threads=1)
            cache.update((w, len(x) if w else 1) for w, x in zip(new, found))
        return np.fromiter((cache[w] for w in words), np.int64, len(words))

    def count(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        lists = pc.split_pattern(texts, " ")
        start = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        start = start - start[0]
        odd = pc.or_(pc.equal(pc.binary_length(flat), 0), pc.match_substring(flat, SPACE))
        odd = np.maximum.reduceat(odd.to_numpy(zero_copy_only=False), start[:-1]) if len(flat) else np.zeros(0, bool)
        index, distinct = encode(flat)
        raw = distinct.cast(pa.large_binary()).to_pylist()
        digests = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
        at = np.minimum(np.searchsorted(self.hashes, digests), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == digests if len(self.hashes) else np.zeros(len(raw), bool)
        sizes = np.zeros(len(raw), np.int64)
        if known.any():
            sizes[known] = self.lengths[at[known]]
        sizes[~known] = self.of_words(distinct.filter(pa.array(~known)).to_pylist())
        total = np.add.reduceat(sizes[index], start[:-1]) if len(flat) else np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(odd):
            total[i] = self._plainly(texts[int(i)].as_py())
        return total

    def _plainly(self, text: str) -> int:
        """A text with spaces in a row, at an end, or with the model's own space sign."""
        if not text:
            return 0
        found = _PRETOKEN.findall(SPACE + text.replace(" ", SPACE))
        return int(self.of_words([x[1:] for x in found]).sum())


#: The sign that stands for a space in pieces, and a pre-token written with it.
SPACE = "\u2581"
_PRETOKEN = re.compile(f"{SPACE}+[^{SPACE}]*")
