"""Token ids as binary files: written in document order, read back block by block.

A file is ``TOKMIX1\\n``, the vocabulary size as a little-endian unsigned 32-bit integer, the blocks
of :mod:`kbcurate.llm.codec` one after another, then the table of its documents (how many of them have
an id, ids and numbers of token ids, all 64-bit integers, deflated), and last four integers: offset of the
table, number of documents, number of token ids (64 bit each) and the CRC-32 of the deflated table (32 bit).
Documents stand in ascending id order within a file and over files by name, those without an id
last (0 in the table of ids); none is split.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kbcurate.llm import codec
from kbcurate.llm.tokens import word_ids
from kbcurate.llm.words import slices

MAGIC = b"TOKMIX1\n"
_TAIL = struct.Struct("<QQQI")
#: A file is closed at the first document end after this many ids.
FILE_TOKENS = 8 << 20
#: Bytes of text encoded at once: the more, the fewer words are looked up.
SLICE = 8 << 20


class _Writer:
    """One file. Its name holds the attempt of its task, so that a retried task never meets a file of
    the attempt before; which of them count is told by the plan alone."""

    def __init__(self, folder: str, name: str, vocabulary: int):
        from pyarrow import fs

        self.fs, root = fs.FileSystem.from_uri(folder)
        self.name, self.final, self.path = name, f"{root}/{name}", f"{root}/_{name}"
        self.out = self.fs.open_output_stream(self.path)
        self.vocabulary, self.ids, self.waiting, self.tokens = vocabulary, [], 0, 0
        self.docs: list[np.ndarray] = []
        self.known = 0
        self.sizes: list[np.ndarray] = []
        self.out.write(MAGIC + struct.pack("<I", vocabulary))

    def add(self, docs: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(docs.fill_null(0).to_numpy(zero_copy_only=False))
        self.known += len(docs) - docs.null_count
        self.sizes.append(sizes)
        self.ids.append(ids)
        self.waiting += len(ids)
        self.tokens += len(ids)
        while self.waiting >= codec.BLOCK:
            self._block(codec.BLOCK)

    def _block(self, n: int) -> None:
        ids = np.concatenate(self.ids)
        self.out.write(codec.encode_block(ids[:n], self.vocabulary))
        self.ids, self.waiting = [ids[n:]], len(ids) - n

    def close(self) -> tuple[str, int, int]:
        if self.waiting:
            self._block(self.waiting)
        docs, sizes = np.concatenate(self.docs), np.concatenate(self.sizes)
        table = zlib.compress(struct.pack("<q", self.known) + docs.astype("<i8").tobytes() + sizes.astype("<i8").tobytes())
        at = self.out.tell()
        self.out.write(table + _TAIL.pack(at, len(docs), self.tokens, zlib.crc32(table)))
        self.out.close()
        self.fs.move(self.path, self.final)
        return self.name, len(docs), self.tokens


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    parts: int | None = None, file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Write the ids of every text (null: empty) and ``end_id`` after each to files in ``folder``,
    a path all executors share; returns the plan of (file, docs, tokens), one row per file, which
    writes when it runs. Every row is a document; they are sorted by id, null ids last, and rows of one
    id by a hash of their text, so that rows of any one id are spread over tasks. An empty table
    makes no file; extra columns are ignored.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the row number is there to part rows that are otherwise alike
    order = ["missing", "id", "hash", "row"]
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    plain = plain.select(
        "id", "text", F.col("id").isNull().alias("missing"), F.xxhash64("text").alias("hash"),
        F.monotonically_increasing_id().alias("row"),
    ).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, context, files, writer = word_ids(tokenizer), TaskContext.get(), [], None
        for batch in batches:
            for part in slices(batch, size=SLICE):
                bounds, ids = words.encode(part.column("text"), end_id)
                if writer is None:
                    name = f"part-{context.partitionId():06d}-{len(files):06d}-{context.taskAttemptId()}.tok"
                    writer = _Writer(folder, name, words.size)
                writer.add(part.column("id"), np.diff(bounds), ids)
                if writer.tokens >= file_tokens:
                    files.append(writer.close())
                    writer = None
        if writer is not None:
            files.append(writer.close())
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("file", "docs", "tokens"), f)) for f in files],
            pa.schema([("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]),
        )

    return plain.mapInArrow(run, "file string, docs long, tokens long")


def file_documents(data: bytes) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(document ids, bounds, token ids) of the documents of a file, about a block at a time."""
    if data[:len(MAGIC)] != MAGIC:
        raise codec.CorruptBlock("not a token file")
    at, n, tokens, crc = _TAIL.unpack_from(data, len(data) - _TAIL.size)
    table = data[at:len(data) - _TAIL.size]
    if zlib.crc32(table) != crc:
        raise codec.CorruptBlock("the table of documents does not agree with its checksum")
    rows = np.frombuffer(zlib.decompress(table), "<i8")
    known, docs, ends = int(rows[0]), rows[1:n + 1], np.cumsum(rows[n + 1:])
    (vocabulary,) = struct.unpack_from("<I", data, len(MAGIC))
    view, offset = memoryview(data), len(MAGIC) + 4
    held, start, done = np.zeros(0, np.uint32), 0, 0
    while offset < at:
        ids, offset = codec.decode_block(view, offset, vocabulary)
        held = np.concatenate([held, ids])
        to = int(np.searchsorted(ends, start + len(held), side="right"))
        if to > done:
            bounds = np.concatenate([[start], ends[done:to]]) - start
            yield pa.array(docs[done:to], mask=np.arange(done, to) >= known), bounds, held[:bounds[-1]]
            held, start, done = held[bounds[-1]:], int(ends[to - 1]), to
    if done != n or start != tokens:
        raise codec.CorruptBlock("documents are missing")


def read_tokens(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids) of every document of the files listed in ``files``
    (written rows of :func:`write_tokens`); ``start`` counts the ids of all documents before it,
    ``ids`` holds little-endian unsigned 32-bit integers. Damaged files raise an error.
    """
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    raw = spark.read.format("binaryFile").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start = batch.column("base")[i].as_py()
                for docs, bounds, ids in file_documents(batch.column("content")[i].as_py()):
                    ids = ids.astype("<u4")
                    pieces = [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            docs, pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)),
                            pa.array([zlib.crc32(x) for x in pieces], pa.int64()), pa.array(pieces, pa.binary()),
                        ],
                        names=["id", "start", "n_tokens", "ids_crc32", "ids"],
                    )
                    start += int(bounds[-1])

    listed = raw.join(F.broadcast(bases), "file")  # one short row per file of some megabytes
    return listed.select("base", "content").mapInArrow(
        run, "id long, start long, n_tokens long, ids_crc32 long, ids binary"
    )
