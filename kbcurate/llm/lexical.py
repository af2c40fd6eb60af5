"""Ranked lexical search, hybrid term-at-a-time and document-at-a-time.

Each worker turns its documents into index segments: the postings of the terms that are asked for,
list after list. For an item, its short lists are summed term at a time into accumulators; these
then act as one more list, with its own bound, beside the long lists, which are walked document
at a time in blocks: a block is skipped when the bounds of its lists cannot reach the item's
fiftieth score so far, and inside a block a document is dropped as soon as what is left cannot.
Only the best of each worker meet in a shuffle; no posting does.

Weights are integers and follow the whole corpus (documents, lengths and document frequencies are
counted over all of it before anything is ranked).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kbcurate.llm.store import Scratch, count_rows
from kbcurate.llm.words import slices

TOP = 50
#: Items ranked in one walk over the index; more are walked in blocks. Bounds what is broadcast.
ITEMS_A_BLOCK = 2_000
#: Documents of an index segment, of a skipped block inside it, and bytes of text split at once.
SEGMENT, BLOCK, PIECE = 16_384, 512, 1 << 20
#: A list is short if it holds at most one document in this many of the segment.
SHORT = 64

_KEPT = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms(text: str | None) -> Counter:
    """Occurrences of the terms of a text, as bytes: runs of letters and digits of ASCII and of all
    other characters beyond it, A-Z lower-cased. Long texts are split a piece at a time."""
    found: Counter = Counter()
    raw = (text or "").encode()
    at = 0
    while at < len(raw):
        to = min(len(raw), at + PIECE)
        while to < len(raw) and _KEPT[raw[to]] != 32:
            to += 1
        found.update(raw[at:to].translate(_KEPT).split())
        at = to
    return found


def _postings(shared):
    """Per document its length and the asked terms it holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: i for i, term in enumerate(shared.value)}
        for batch in batches:
            for part in slices(batch):
                sizes, ids, times = [], [], []
                for text in part.column("text").to_pylist():
                    found = terms(text)
                    sizes.append(sum(found.values()))
                    mine = sorted(
                        (number[t], n) for t, n in found.items() if t in number
                    ) if len(found) < len(number) else sorted(
                        (i, found[t]) for t, i in number.items() if t in found
                    )
                    ids.append([i for i, _ in mine])
                    times.append([n for _, n in mine])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                     pa.array(times, pa.list_(pa.int64()))],
                    names=["id", "n", "terms", "times"],
                )
    return run


class _Segment:
    """Postings of a run of documents, sorted by term, then document."""

    def __init__(self, batches: list[pa.RecordBatch], weights: np.ndarray, count: int, length: int, block: int = BLOCK):
        table = pa.Table.from_batches(batches).combine_chunks()
        ids = table.column("id")
        self.known = ids.is_valid().to_numpy()
        self.ids = ids.fill_null(0).to_numpy()
        self.size = len(self.ids)
        lists = table.column("terms").combine_chunks()
        held = np.diff(lists.offsets.to_numpy())
        term = lists.flatten().to_numpy()
        tf = table.column("times").combine_chunks().flatten().to_numpy()
        n = table.column("n").to_numpy()
        m = 50 + 50 * n * count // max(length, 1)
        doc = np.repeat(np.arange(self.size), held)
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order]
        self.docs = doc
        self.gains = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        self.bounds = np.searchsorted(term, np.arange(len(weights) + 1))
        self.block, self.blocks = block, -(-self.size // block)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.bounds[term], self.bounds[term + 1])
        return self.docs[span], self.gains[span]

    def block_bounds(self, docs: np.ndarray, gains: np.ndarray) -> np.ndarray:
        best = np.zeros(self.blocks, np.int64)
        if len(docs):
            block = docs // self.block
            heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            best[block[heads]] = np.maximum.reduceat(gains, heads)
        return best


def _gain_of(docs: np.ndarray, gains: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Gains of the wanted documents in one list, zero where it lacks them."""
    if not len(docs):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
    return np.where(docs[at] == wanted, gains[at], 0)


class _Best:
    """The best documents of an item so far: higher scores first, then smaller ids, nulls last."""

    def __init__(self, top: int):
        self.top = top
        self.ids = self.scores = np.zeros(0, np.int64)
        self.known = np.zeros(0, bool)

    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, ids: np.ndarray, known: np.ndarray, scores: np.ndarray) -> None:
        ids, known = np.concatenate([self.ids, ids]), np.concatenate([self.known, known])
        scores = np.concatenate([self.scores, scores])
        order = np.lexsort((ids, ~known, -scores))[: self.top]
        self.ids, self.known, self.scores = ids[order], known[order], scores[order]


def _rank(segment: _Segment, asked: np.ndarray, best: _Best, rare: int = SHORT) -> None:
    """Documents of a segment that belong to the best of an item."""
    lists = [segment.postings(t) for t in asked]
    lists = sorted((x for x in lists if len(x[0])), key=lambda x: len(x[0]))
    if not lists:
        return
    short = sum(len(docs) * rare <= segment.size for docs, _ in lists)
    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if short:  # term at a time
        docs = np.concatenate([docs for docs, _ in lists[:short]])
        gains = np.concatenate([gains for _, gains in lists[:short]])
        order = np.argsort(docs, kind="stable")
        docs, gains = docs[order], gains[order]
        heads = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        held = docs[heads], np.add.reduceat(gains, heads)
    # document at a time over the accumulators and the long lists, those that add most first
    iterators = [(held, segment.block_bounds(*held)), *((x, segment.block_bounds(*x)) for x in lists[short:])]
    iterators.sort(key=lambda x: -int(x[1].max(initial=0)))
    bounds = np.stack([b for _, b in iterators])
    after = np.concatenate([np.cumsum(bounds[::-1], axis=0)[::-1], np.zeros((1, segment.blocks), np.int64)])
    order = np.argsort(-after[0], kind="stable")
    step = 1
    at = 0
    while at < len(order):
        some = order[at:at + step]
        some = np.sort(some[after[0, some] >= best.floor()])
        at, step = at + step, min(step * 2, 64)
        if not len(some):
            return  # blocks come by falling bounds
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, ((mine, gains), _) in enumerate(iterators):
            scores = scores + _gain_of(mine, gains, docs)
            floor = best.floor()
            # a document first met here can still make it only in blocks with enough left
            open_blocks = some[after[i, some] >= floor]
            if len(open_blocks):
                low = np.searchsorted(mine, open_blocks * segment.block)
                high = np.searchsorted(mine, (open_blocks + 1) * segment.block)
                width = high - low
                pick = np.repeat(low - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
                new = mine[pick]
                fresh = ~np.isin(new, docs, assume_unique=True)
                docs = np.concatenate([docs, new[fresh]])
                scores = np.concatenate([scores, gains[pick][fresh]])
            alive = scores + after[i + 1, docs // segment.block] >= floor
            docs, scores = docs[alive], scores[alive]
        full = scores > 0
        docs, scores = docs[full], scores[full]
        best.add(segment.ids[docs], segment.known[docs], scores)


def _search(shared, top: int, size: int, block: int, rare: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, count, length = shared.value
        best = [_Best(top) for _ in items]
        held: list[pa.RecordBatch] = []

        def flush():
            segment = _Segment(held, weights, count, length, block)
            for asked, mine in zip(items, best):
                _rank(segment, asked, mine, rare)
            held.clear()

        rows = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - rows)
                held.append(part)
                rows, at = rows + part.num_rows, at + part.num_rows
                if rows == size:
                    flush()
                    rows = 0
        if held:
            flush()
        for i, mine in enumerate(best):
            if len(mine.ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(mine.ids), i, np.int32)), pa.array(mine.ids, mask=~mine.known), pa.array(mine.scores)],
                    names=["item", "doc", "score"],
                )
    return run


def _split_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            found = [sorted(terms(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("item"), pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"]
            )


def weight(count: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1)))


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", query_col: str = "text", top: int = TOP,
    segment: int = SEGMENT, block: int = BLOCK, rare: int = SHORT,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0.

    Equal scores go by smaller id, null ids last. A null or empty text has no terms: such a document is
    in no result and not counted, such an item has no result. Every row of ``docs`` is a document
    (repeated rows take ranks of their own); rows of one item id are one item with the terms of all
    of them. Terms of an item count once each. Empty tables give an empty result; extra columns are ignored.

    Items are ranked in blocks of ``ITEMS_A_BLOCK``, each a walk over the documents; what is
    broadcast is the terms of one block and their weights. ``segment``, ``block`` and ``rare`` shape the
    index (documents of a segment, of a block, and how rare a short list's term is), not the result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{query_col}`").alias("text"))
    wanted, seen = scratch.write(
        asked.mapInArrow(_split_items, "item long, terms array<binary>")
        .select("item", F.explode("terms").alias("term")).distinct().groupBy("item")
        .agg(F.array_sort(F.collect_list("term")).alias("terms")), count_rows(),
    )
    blocks = max(1, -(-seen["n"] // ITEMS_A_BLOCK))
    found = None
    for at in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == at).orderBy("item").collect()
        part = _ranked(scratch, plain, [(r["item"], r["terms"]) for r in rows], top, (segment, block, rare))
        found = part if found is None else found.unionByName(part)
    return found


def _ranked(scratch: Scratch, plain: DataFrame, rows: list, top: int, shape: tuple[int, int, int]) -> DataFrame:
    spark = plain.sparkSession
    sc = spark.sparkContext
    vocabulary = sorted({bytes(t) for _, ts in rows for t in ts})
    index, seen = scratch.write(
        plain.mapInArrow(_postings(sc.broadcast(vocabulary)), "id long, n long, terms array<int>, times array<long>")
        .where("n > 0"),
        count_rows(), F.coalesce(F.sum("n"), F.lit(0)).alias("length"),
    )
    df = np.zeros(len(vocabulary), np.int64)
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    weights = np.array([weight(seen["n"], int(x)) for x in df], np.int64)
    number = {t: i for i, t in enumerate(vocabulary)}
    asked = [np.array([number[bytes(t)] for t in ts]) for _, ts in rows]
    best = index.where(F.size("terms") > 0).mapInArrow(
        _search(sc.broadcast((asked, weights, seen["n"], seen["length"])), top, *shape), "item int, doc long, score long"
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(rows)], "item int, item_id long")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(names), "item").select(
        "item_id", "rank", F.col("doc").alias("doc_id"), "score"
    )
