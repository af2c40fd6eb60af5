"""Near-duplicates by min-max hashing: both ends of every permutation, banded, then exact checks.

Every document's set of word shingles is hashed under ``HASHES`` permutations, and of each both the
least and the greatest value are kept: two values per evaluation, each of which agrees between two
documents with a probability equal to their Jaccard similarity. Values are banded by four.

1. Documents with equal sets form a class; only its smallest id goes on.
2. Documents that share a band are compared by their values (128 small numbers): connected by an
   estimate of ``ESTIMATE`` or more, they form a blob. A blob holds all links of its documents.
   A bucket above ``BUCKET`` documents joins its blob whole, without estimates.
3. Blobs are resolved on full sets, in groups of at most ``CHUNK`` documents: a blob above that is
   cut into chunks with a few pivots in common, and then every document outside the blob's largest
   component is compared with all others of its blob. Only pairs already connected are skipped,
   so no connection between blob members is lost, and no group is paired out.

A link is missed only if no band agrees (5e-6 at a similarity of 0.75, less above) or the estimate
is four standard deviations off. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kbcurate.llm.graph import components
from kbcurate.llm.memory import tidy
from kbcurate.llm.store import Scratch, count_rows, sized
from kbcurate.llm.words import Rolling, hash_words, mix, slices, to_long

SHINGLE = 5
PERCENT = 75
HASHES = 64
BANDS = 32
ESTIMATE = 0.60
BUCKET = 512
CHUNK = 256
PIVOTS = 8
#: Bytes of text sketched at once.
SLICE = 1 << 20

_FACTORS = np.random.default_rng(20260101).integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Bounds per document and the sorted distinct shingle hashes of each. With fewer words than
    ``size`` the whole sequence is the one shingle; without words the set is empty."""
    words = hash_words(texts, lower=True)
    counts = words.counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(n)), n)
    first = np.concatenate([[0], np.cumsum(n)])
    begin = words.start[:-1][doc] + np.arange(len(doc)) - first[:-1][doc]
    spans = Rolling(words.hash).spans(begin, np.minimum(begin + size, words.start[1:][doc]))
    order = np.lexsort((spans, doc))
    spans, doc = spans[order], doc[order]
    new = np.ones(len(spans), bool)
    new[1:] = (spans[1:] != spans[:-1]) | (doc[1:] != doc[:-1])
    spans, doc = spans[new], doc[new]
    return np.searchsorted(doc, np.arange(len(n) + 1)), spans


def signatures(bounds: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """uint32 matrix: least values of all permutations, then greatest. All sets are nonempty."""
    short = (spans >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, 2 * HASHES), np.uint32)
    for j, factor in enumerate(_FACTORS):
        values = short * factor
        out[:, j] = np.minimum.reduceat(values, bounds[:-1])
        out[:, HASHES + j] = np.maximum.reduceat(values, bounds[:-1])
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """64-bit key per document and band: two least values and two greatest of other permutations."""
    per, half = HASHES // BANDS, HASHES // 2
    keys = np.empty((len(values), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(values), band + 1, np.uint64)
        for j in range(band * per, (band + 1) * per):
            for column in (j, HASHES + (j + half) % HASHES):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, column])
        keys[:, band] = key
    return keys


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, size=SLICE):
            bounds, spans = shingle_sets(part.column("text"))
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            raw = spans.tobytes()
            keys = np.zeros((part.num_rows, 2), np.uint64)
            for i in full:
                whole = xxhash.xxh3_128_intdigest(raw[8 * bounds[i]:8 * bounds[i + 1]])
                keys[i] = whole >> 64, whole & (1 << 64) - 1
            bands, short = [None] * part.num_rows, [None] * part.num_rows
            if len(full):
                values = signatures(np.append(bounds[:-1][full], bounds[-1]), spans)
                banded, small = band_keys(values).view(np.int64), mix(values.astype(np.uint64)).astype(np.uint8)
                for row, i in enumerate(full):
                    bands[i], short[i] = banded[row], small[row].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"), pa.array(n, pa.int64()), to_long(keys[:, 0].copy()),
                    to_long(keys[:, 1].copy()), pa.array(bands, pa.list_(pa.int64())),
                    pa.array(short, pa.binary()),
                ],
                names=["id", "n", "k1", "k2", "bands", "values"],
            )


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of rows that come sorted by ``key``, many groups at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1])) if keys[0] != keys[-1] else 0
        if held and held[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _fits(sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sizes allow the similarity at all."""
    return 100 * np.minimum(sizes[a], sizes[b]) >= PERCENT * np.maximum(sizes[a], sizes[b])


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket, a star from the least row of every part connected by estimates."""
    enough = int(ESTIMATE * 2 * HASHES)
    for table in _groups(batches, "key"):
        keys = table.column("key").to_numpy()
        ids, sizes = table.column("id").to_numpy(), table.column("size").to_numpy()
        values = _matrix(table.column("values"), 2 * HASHES)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(starts, len(keys)))
        label = np.arange(len(keys))
        for m in np.unique(counts[counts > 1]):
            left, right = np.triu_indices(m, 1)
            per = max(1, (1 << 18) // len(left))
            heads = starts[counts == m]
            for at in range(0, len(heads), per):
                a = (heads[at:at + per, None] + left).ravel()
                b = (heads[at:at + per, None] + right).ravel()
                fit = _fits(sizes, a, b)
                a, b = a[fit], b[fit]
                near = np.zeros(len(a), bool)
                for piece in range(0, len(a), 1 << 16):
                    some = slice(piece, piece + (1 << 16))
                    near[some] = (values[a[some]] == values[b[some]]).sum(axis=1) >= enough
                a, b = a[near], b[near]
                while len(a):
                    low = np.minimum(label[a], label[b])
                    before = label[a].sum() + label[b].sum()
                    np.minimum.at(label, a, low)
                    np.minimum.at(label, b, low)
                    if label[a].sum() + label[b].sum() == before:
                        break
        tied = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[tied]), pa.array(ids[label[tied]])], names=["a", "b"]
        )


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= PERCENT * (len(x) + len(y) - shared)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between documents of a group, on full sets, that connect what is not connected yet.

    Rows of one ``known`` component count as connected. Best estimates come first.
    """
    enough = int(ESTIMATE * 2 * HASHES)
    for table in _groups(batches, "grp"):
        grp = table.column("grp").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]]))
        for begin, end in zip(starts, np.append(starts[1:], len(grp))):
            part = table.slice(begin, end - begin)
            ids = part.column("id").to_numpy()
            known = part.column("known").to_numpy()
            bounds, spans = shingle_sets(part.column("text").combine_chunks())
            sizes = np.diff(bounds)
            values = _matrix(part.column("values"), 2 * HASHES)
            root = {int(k): int(k) for k in known}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            pairs, scores = [], []
            for i in range(len(ids) - 1):
                j = np.arange(i + 1, len(ids))
                j = j[(known[j] != known[i]) & _fits(sizes, np.full(len(j), i), j)]
                score = (values[j] == values[i]).sum(axis=1)
                good = score >= enough
                pairs.append(np.column_stack([np.full(good.sum(), i), j[good]]))
                scores.append(score[good])
            if not pairs:
                continue
            pairs, scores = np.concatenate(pairs), np.concatenate(scores)
            a, b = [], []
            for i, j in pairs[np.argsort(-scores, kind="stable")]:
                x, y = find(int(known[i])), find(int(known[j]))
                if x != y and _similar(spans[bounds[i]:bounds[i + 1]], spans[bounds[j]:bounds[j + 1]]):
                    root[max(x, y)] = min(x, y)
                    a.append(int(ids[i]))
                    b.append(int(ids[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _grouped(rows: DataFrame, key: str, worker, partitions: int) -> DataFrame:
    return rows.repartition(partitions, key).sortWithinPartitions(key).mapInArrow(tidy(worker), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of ``docs``.

    Texts are lower-cased in A-Z; documents are linked when 100 * shared >= 75 * all of their
    distinct five-word shingles, and ``component_id`` is the smallest id reachable. A document
    without words (or a null text) is linked with nothing; rows with a null id have a null
    component and are kept; repeated rows of one id are one document; extra columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sketches = scratch.write(plain.mapInArrow(
        tidy(_sketch), "id long, n long, k1 long, k2 long, bands array<long>, values binary"
    ))
    usable = sketches.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = scratch.write(usable.groupBy("k1", "k2").agg(F.min("id").alias("class")))
    heads = scratch.write(
        usable.join(classes.select("k1", "k2", F.col("class").alias("id")), ["id", "k1", "k2"], "left_semi")
        .dropDuplicates(["id", "k1", "k2"]).select("id", F.col("n").alias("size"), "bands", "values")
    )

    keyed = heads.select("id", F.explode("bands").alias("key"))
    buckets = scratch.write(
        keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("least")).where(F.col("m") > 1)
    )
    members = scratch.write(keyed.join(buckets, "key"))
    few = members.where(F.col("m") <= BUCKET).groupBy("id").agg(F.collect_list("key").alias("keys"))
    valued = heads.select("id", "size", "values").join(few, "id").select(
        "id", "size", "values", F.explode("keys").alias("key")
    )
    close = _grouped(valued, "key", _estimate, wide).union(
        members.where((F.col("m") > BUCKET) & (F.col("id") != F.col("least")))
        .select(F.col("id").alias("a"), F.col("least").alias("b"))
    )
    blobs = scratch.write(components(close).withColumnRenamed("component", "blob"))
    scratch.drop(buckets, members)

    sizes = scratch.write(blobs.groupBy("blob").agg(F.count(F.lit(1)).alias("m")))
    placed, seen = scratch.write(
        blobs.join(sizes, "blob"), count_rows(), F.coalesce(F.max("m"), F.lit(0)).alias("largest")
    )
    found = plain.join(sized(placed.select("id"), seen["n"]), "id", "left_semi").dropDuplicates(["id"])
    texts = scratch.write(found.join(placed, "id").join(
        heads.select("id", "values").dropDuplicates(["id"]), "id"
    ))
    scratch.drop(heads, placed, sizes)
    links = scratch.write(_within(texts, wide))
    if seen["largest"] > CHUNK:
        links = links.union(scratch.write(_across(texts, links, wide)))
    scratch.drop(texts)

    joined = components(links).select(F.col("id").alias("class"), "component")
    named = scratch.write(
        classes.join(joined, "class", "left")
        .select("k1", "k2", F.coalesce("component", "class").alias("component_id"))
    )
    keys = [F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col(k)).alias(k) for k in ("k1", "k2")]
    return (
        sketches.select("id", "n", *keys).join(named, ["k1", "k2"], "left")
        .select(
            "id", F.col("n").alias("n_shingles"),
            F.coalesce("component_id", "id").alias("component_id"),
            F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"),
        )
    )


def _within(texts: DataFrame, partitions: int) -> DataFrame:
    """Links inside every chunk of a blob; its pivots are in all of its chunks."""
    chunks = F.ceil(F.col("m") / CHUNK)
    pivot = (chunks > 1) & (F.pmod(F.xxhash64("id", F.lit(7)), F.col("m")) < PIVOTS)
    own = F.array(F.pmod(F.xxhash64("id"), chunks))
    rows = texts.withColumn("chunk", F.explode(F.when(pivot, F.sequence(F.lit(0).cast("long"), chunks - 1)).otherwise(own)))
    return _grouped(
        rows.select(F.xxhash64("blob", "chunk").alias("grp"), "id", F.col("id").alias("known"), "text", "values"),
        "grp", _resolve, partitions,
    )


def _across(texts: DataFrame, links: DataFrame, partitions: int) -> DataFrame:
    """Links of documents outside the largest component of a cut blob with all others of it."""
    half = CHUNK // 2
    cut = texts.where(F.col("m") > CHUNK)
    state = cut.join(components(links), "id", "left").select(
        "id", "blob", "m", F.coalesce("component", "id").alias("known")
    )
    largest = state.groupBy("blob", "known").agg(F.count(F.lit(1)).alias("c")).groupBy("blob").agg(
        F.max_by("known", F.struct("c", "known")).alias("main"), (F.sum("c") - F.max("c")).alias("outside")
    ).where(F.col("outside") > 0)
    rows = cut.select("id", "text", "values").join(state.join(largest, "blob"), "id")
    outer, inner = F.ceil(F.col("outside") / half), F.ceil(F.col("m") / half)

    def dealt(df: DataFrame, own, others, mine_first: bool) -> DataFrame:
        at = F.pmod(F.xxhash64("id", F.lit(int(mine_first))), own)
        df = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)).alias("other"))
        pair = (at, F.col("other")) if mine_first else (F.col("other"), at)
        return df.select(F.xxhash64("blob", *pair).alias("grp"), "id", "known", "text", "values")

    both = dealt(rows.where(F.col("known") != F.col("main")), outer, inner, True).union(
        dealt(rows, inner, outer, False)
    )
    return _grouped(both, "grp", _resolve, partitions)
