"""Token counts by a two-tier lookup on the map side: a broadcast table of frequent pre-token
lengths, and worker caches over the library for all others. No pre-token is shuffled for its count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from kbcurate.llm.tokens import PieceCounts
from kbcurate.llm.words import encode, slices

#: Pre-tokens of the broadcast table: 12 bytes each, so under 1 MB whatever the input.
TABLE = 65_536
#: Pre-tokens a task reports, and how many it keeps while counting.
REPORT, HELD = 4_096, 65_536


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pre-tokens a task saw most. Counts of rare ones may be forgotten on the way; the table
    only decides what is looked up where, never a result."""
    seen: Counter[str] = Counter()
    for batch in batches:
        for part in slices(batch):
            texts = pc.fill_null(part.column("text"), "").cast(pa.large_string())
            index, distinct = encode(pc.split_pattern(texts, " ").flatten())
            times = np.bincount(index, minlength=len(distinct))
            top = np.argsort(-times, kind="stable")[:HELD]
            seen.update(dict(zip(distinct.take(pa.array(top)).to_pylist(), times[top].tolist())))
            if len(seen) > 2 * HELD:
                seen = Counter(dict(seen.most_common(HELD)))
    most = seen.most_common(REPORT)
    yield pa.RecordBatch.from_arrays(
        [pa.array([w for w, _ in most], pa.string()), pa.array([n for _, n in most], pa.int64())],
        names=["word", "times"],
    )


def frequent_words(docs: DataFrame, text_col: str, size: int = TABLE) -> list[str]:
    """At most ``size`` frequent pre-tokens of all texts, from one short report per task."""
    reports = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(_frequent, "word string, times long")
    top = reports.groupBy("word").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "word").limit(size)
    return [r[0] for r in top.collect()]


def token_counts(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096,
    table: int = TABLE,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row: pieces of the whole text under the
    sentencepiece file ``model`` (read on every worker), UTF-8 bytes, and n_tokens > limit.

    A null or empty text has none. Ids may be null or repeated; extra columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    words = frequent_words(docs, text_col, table)
    counter = PieceCounts(model, np.zeros(0, np.uint64), np.zeros(0, np.int32))
    lengths = counter.of_words(words).astype(np.int32)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    order = np.argsort(hashes)
    shared = spark.sparkContext.broadcast((hashes[order], lengths[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts(model, *shared.value)
        for batch in batches:
            for part in slices(batch):
                text = part.column("text")
                n = counts.count(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), pc.fill_null(pc.binary_length(text), 0).cast(pa.int64()),
                        pa.array(n, pa.int64()), pa.array(n > limit),
                    ],
                    names=["id", "n_bytes", "n_tokens", "over_limit"],
                )

    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return plain.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")
