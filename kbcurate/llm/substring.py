"""Substring dedup: winnowed anchors seed matches, contexts extend them both ways, and words
covered by a repeat of at least ``window`` words are removed.

Anchors are k-word hashes picked by winnowing: of any ``window`` words in a row at least one
anchor is picked, and the same one wherever the same words stand. Two documents can therefore
share a window only if they share its anchor. From an anchor the match is extended in two steps:

1. to the widest context any window around it can reach (``window - k`` words to both sides).
   If a smaller document has the same context, the match goes all the way and all of it is
   covered;
2. only where contexts of one anchor differ, that is where a match ends near the anchor, the
   windows around it are compared one by one, so the match ends at the exact word.

Both steps ask for the smallest document of a key, a map-side combined minimum, and never pair
the documents of a group: a passage in a third of all documents costs one row per task and key.
Texts are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from kbcurate.llm.memory import tidy
from kbcurate.llm.store import Scratch, count_rows, sized
from kbcurate.llm.words import (
    Rolling, hash_words, mix, slices, sliding, split_words, to_long, window_starts,
)

WINDOW = 50
ANCHOR = 12
#: Bytes of text handled at once.
SLICE = 1 << 20

_SPAN = T.StructType().add("start", "long").add("end", "long")
_ADDED = T.StructType().add("n_words", "long").add("n_removed", "long").add(
    "spans", T.ArrayType(_SPAN)
).add("kept_text", "string")


def _anchors(words, rolling: Rolling, window: int, k: int):
    """(document, position, anchor hash, context hash, context start, context end) of each anchor,
    and the picked anchor hash of every window of ``window`` words with its start."""
    starts, doc = window_starts(words.start, k)
    long = words.counts[doc] >= window
    starts, doc = starts[long], doc[long]
    grams, run, reach = rolling.spans(starts, starts + k), window - k + 1, window - k
    empty = np.zeros(0, np.int64)
    if len(grams) < run:
        return (empty,) * 6, (empty, empty.view(np.uint64), empty)
    least = sliding(grams, run, np.minimum)
    whole = doc[: len(least)] == doc[run - 1:]
    edge = np.zeros(run - 1, np.uint64)
    reached = sliding(np.concatenate([edge, np.where(whole, least, np.uint64(0)), edge]), run, np.maximum)
    picked = reached == grams
    p, d, h = starts[picked], doc[picked], grams[picked]
    low, high = np.maximum(p - reach, words.start[d]), np.minimum(p + k + reach, words.start[d + 1])
    context = mix(rolling.spans(low, high) ^ rolling.spans(low, p) * np.uint64(3))
    return (d, p, h, context, low, high), (doc[: len(least)][whole], least[whole], starts[: len(least)][whole])


def _long_list(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(name)
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [
        values[offsets[i]:offsets[i + 1]].view(np.uint64) if valid[i] else np.zeros(0, np.uint64)
        for i in range(batch.num_rows)
    ]


def _seeds(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SLICE):
                words = hash_words(part.column("text"))
                (doc, _, anchor, context, _, _), _ = _anchors(words, Rolling(words.hash), window, k)
                key = np.rec.fromarrays([doc, anchor, context])
                _, first = np.unique(key, return_index=True)
                ids = part.column("id").take(pa.array(doc[first]))
                yield pa.RecordBatch.from_arrays(
                    [ids, to_long(anchor[first]), to_long(context[first])], names=["id", "anchor", "context"]
                )
    return run


def _windows(window: int, k: int):
    """Hashes of the windows picked by the anchors of the contexts asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SLICE):
                words = hash_words(part.column("text"))
                rolling = Rolling(words.hash)
                (doc, p, anchor, context, _, _), (wdoc, wanchor, wstart) = _anchors(words, rolling, window, k)
                asked = _long_list(part, "contexts")
                bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
                wbounds = np.searchsorted(wdoc, np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    mine = slice(bounds[i], bounds[i + 1])
                    want = np.isin(context[mine], asked[i])
                    if not want.any():
                        continue
                    at, of = p[mine][want], slice(wbounds[i], wbounds[i + 1])
                    near = np.isin(wanchor[of], anchor[mine][want])
                    begin = wstart[of][near]
                    after = np.searchsorted(at, begin)  # the window must hold an asked anchor
                    held = (after < len(at)) & (at[np.minimum(after, len(at) - 1)] <= begin + window - k)
                    begin = begin[held]
                    found = np.unique(rolling.spans(begin, begin + window))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(np.full(len(found), i))), to_long(found)],
                        names=["id", "key"],
                    )
    return run


def _cut(window: int, k: int, names: list[str]):
    """Remove what is covered: words inside covered contexts and covered windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SLICE):
                words = hash_words(part.column("text"))
                rolling = Rolling(words.hash)
                (doc, _, _, context, low, high), _ = _anchors(words, rolling, window, k)
                contexts, windows = _long_list(part, "contexts"), _long_list(part, "windows")
                bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
                start, flat = split_words(part.column("text"))
                removed, spans, texts = [], [], []
                for i in range(part.num_rows):
                    n, first = int(start[i + 1] - start[i]), start[i]
                    mine = slice(bounds[i], bounds[i + 1])
                    hit = np.isin(context[mine], contexts[i])
                    begin, end = low[mine][hit] - first, high[mine][hit] - first
                    if len(windows[i]) and n >= window:
                        at = np.arange(first, start[i + 1] - window + 1)
                        at = at[np.isin(rolling.spans(at, at + window), windows[i])] - first
                        begin, end = np.concatenate([begin, at]), np.concatenate([end, at + window])
                    depth = np.zeros(n + 1, np.int64)
                    np.add.at(depth, begin, 1)
                    np.add.at(depth, end, -1)
                    covered = np.cumsum(depth[:n]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                    removed.append(int(covered.sum()))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                    kept = flat.slice(first, n).filter(pa.array(~covered)) if covered.any() else None
                    texts.append(None if kept is None else " ".join(kept.to_pylist()))
                whole = pc.cast(part.column("text"), pa.string())
                texts = pc.coalesce(pa.array(texts, pa.string()), whole)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in names], pa.array(np.diff(start)),
                        pa.array(removed, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        texts,
                    ],
                    names=[*names, "n_words", "n_removed", "spans", "kept_text"],
                )
    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR
) -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct), n_words, n_removed, spans (word positions
    ``[start, end)`` removed) and kept_text (the text itself if nothing is removed, else the kept
    words joined by one space).

    A word goes if a window of ``window`` words that covers it also starts in a document with a
    smaller id; windows are judged on the input. A null or empty text has no words; shorter texts
    than a window are kept; rows with a null id are kept whole and remove nothing; rows of one id
    do not remove each other; an empty table gives an empty result. Extra columns stay in ``row``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = plain.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    seeds = scratch.write(known.mapInArrow(tidy(_seeds(window, anchor)), "id long, anchor long, context long"))
    shared = scratch.write(
        seeds.groupBy("anchor").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .where(F.col("first") < F.col("last")).select("anchor", "first")
    )
    found = scratch.write(seeds.join(shared, "anchor"))
    scratch.drop(seeds, shared)
    least = scratch.write(
        found.groupBy("anchor", "context", "first").agg(F.min("id").alias("leader"))
    )
    copied = found.join(least.select("anchor", "context", "leader"), ["anchor", "context"]).where(
        F.col("leader") < F.col("id")
    ).select("id", F.col("context").alias("key"), F.lit(True).alias("is_context"))
    several = scratch.write(
        least.where(F.col("leader") > F.col("first")).select("anchor").distinct()
    )
    wanted, seen = scratch.write(
        least.join(several, "anchor", "left_semi").groupBy(F.col("leader").alias("id"))
        .agg(F.collect_set("context").alias("contexts")), count_rows(),
    )
    texts = known.join(sized(wanted.select("id"), seen["n"]), "id", "left_semi")
    windows = scratch.write(
        texts.join(wanted, "id").mapInArrow(tidy(_windows(window, anchor)), "id long, key long")
    )
    firsts = scratch.write(
        windows.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .where(F.col("first") < F.col("last")).select("key", "first")
    )
    inside = windows.join(firsts, "key").where(F.col("first") < F.col("id")).select(
        "id", "key", F.lit(False).alias("is_context")
    )
    hits, seen = scratch.write(
        copied.union(inside).groupBy("id").agg(
            F.collect_set(F.when(F.col("is_context"), F.col("key"))).alias("contexts"),
            F.collect_set(F.when(~F.col("is_context"), F.col("key"))).alias("windows"),
        ), count_rows(),
    )
    scratch.drop(found, least, several, wanted, windows, firsts)

    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"),
    )
    names = ["row"]
    few = sized(hits.select("id"), seen["n"])
    none = F.array().cast("array<long>")
    schema = rows.select("row").schema
    for column in _ADDED:
        schema = schema.add(column)
    touched = rows.join(few, "id", "left_semi").join(hits, "id")
    untouched = rows.join(few, "id", "left_anti").withColumns({"contexts": none, "windows": none})
    columns = ["row", "text", "contexts", "windows"]
    plain_rows = untouched.select("row", "text").mapInArrow(tidy(_count(names)), schema)
    return plain_rows.unionByName(touched.select(*columns).mapInArrow(tidy(_cut(window, anchor, names)), schema))


def _count(names: list[str]):
    """Rows of which nothing is removed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SLICE):
                start, _ = split_words(part.column("text"))
                n = part.num_rows
                spans = pa.array([[]] * n, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in names], pa.array(np.diff(start)),
                        pa.array(np.zeros(n, np.int64)), spans, pc.cast(part.column("text"), pa.string()),
                    ],
                    names=[*names, "n_words", "n_removed", "spans", "kept_text"],
                )
    return run


def kept_sha256(text):
    """Hex SHA-256 of the words of a text joined by one space (null: of nothing)."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.sha2(F.encode(F.trim(squeezed), "UTF-8"), 256)
