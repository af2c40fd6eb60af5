"""Packing of token sequences by shortest-pack-first over the histogram of lengths.

Documents are cut at multiples of the sequence size; only the histogram of piece lengths, at most
``size`` numbers, meets in one place. There, lengths are placed longest first into the shortest open
pattern with room, by counts. Patterns are then joined back to pieces by their rank among
the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kbcurate.llm.memory import tidy
from kbcurate.llm.store import Scratch
from kbcurate.llm.tokens import word_ids
from kbcurate.llm.words import slices

SIZE = 2048
#: Bytes of text handled at once.
SLICE = 2 << 20
#: Pieces of a length that are ranked in one task.
RANKED = 50_000


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each with its count, that use every length of the histogram as often
    as it says. All lengths are from 1 to ``size``.

    Lengths go longest first; all pieces of a length are dealt to open patterns by number: to
    the one that is filled least, if there is room, else to new ones.
    """
    open_by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in open_by_room if r >= length), default=0)
            if room:
                pattern, count = open_by_room[room].popitem()
                if not open_by_room[room]:
                    del open_by_room[room]
            else:
                pattern, room, count = (), size, left
            used = min(count, left)
            if count > used:
                open_by_room[room][pattern] += count - used
            open_by_room[room - length][(*pattern, length)] += used
            left -= used
    return sorted((p, c) for by in open_by_room.values() for p, c in by.items())


def places(patterns: list[tuple[tuple[int, ...], int]], size: int) -> tuple[np.ndarray, ...]:
    """Sorted by key: key (length, rank of the first piece), first sequence, offset. The pieces of a
    length from that rank on lie, one each, in the sequences from there on."""
    rows, taken, sequence = [], defaultdict(int), 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return (table[:, 0] << 48) + table[:, 1], table[:, 2], table[:, 3]


def _pieces(tokenizer: str, end_id: int, size: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch in batches:
            for part in slices(batch, size=SLICE):
                bounds, ids = words.encode(part.column("text"), end_id)
                total = np.diff(bounds)
                cuts = -(-total // size)
                doc = np.repeat(np.arange(part.num_rows), cuts)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = nth * size
                length = np.minimum(size, total[doc] - start)
                raw = memoryview(ids.astype("<u4").tobytes())
                begin = bounds[:-1][doc] + start
                pieces = [raw[4 * a:4 * b] for a, b in zip(begin, begin + length)]
                columns = {
                    "id": part.column("id").take(pa.array(doc)), "start": pa.array(start), "length": pa.array(length),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in pieces], pa.int64()),
                    "doc_tokens": pa.array(total[doc]),
                }
                if keep_ids:
                    columns["ids"] = pa.array([bytes(x) for x in pieces], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)
    return run


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) per piece.

    Every document is its ids and ``end_id`` (null text: ``end_id`` alone), cut at multiples of
    ``size``; pieces of a sequence lie side by side from offset 0. Ids may be null or repeated (each
    row is a document of its own); extra columns are ignored; an empty table gives no piece.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = "id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    pieces = scratch.write(plain.mapInArrow(tidy(_pieces(tokenizer, end_id, size, keep_ids)), kind))

    # ranks within a length: pieces are dealt to groups of about RANKED, whose counts are summed
    total = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("c"))
    groups = {r["length"]: r["c"] for r in total.collect()}  # at most ``size`` rows
    if not groups:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    many = -(-max(groups.values()) // RANKED)
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(many)))
    along = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    before = scratch.write(
        dealt.groupBy("length", "deal").agg(F.count(F.lit(1)).alias("c"))
        .select("length", "deal", F.coalesce(F.sum("c").over(along), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("length", "deal").orderBy("id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("r", F.row_number().over(inside) - 1).join(before, ["length", "deal"]).select(
        *pieces.columns, (F.col("before") + F.col("r")).alias("rank")
    )
    shared = spark.sparkContext.broadcast(places(shortest_pack_first(groups, size), size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, offsets = shared.value
        for batch in batches:
            key = (batch.column("length").to_numpy() << 48) + batch.column("rank").to_numpy()
            at = np.searchsorted(keys, key, side="right") - 1
            rest = batch.drop_columns(["rank"])
            yield rest.append_column("sequence_id", pa.array(sequences[at] + key - keys[at])).append_column(
                "offset", pa.array(offsets[at])
            )

    return ranked.mapInArrow(place, kind + ", sequence_id long, offset long")
