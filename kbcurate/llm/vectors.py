"""Embedding near-dedup: an exact range join in cells around pivots.

Vectors are compared on the unit sphere, where a cosine of at least c is a distance of at most
``sqrt(2 - 2 c)``. Pivots, a seeded pick of vectors as many as the table needs, cut the space into
cells of their nearest vectors. By the triangle inequality a vector can have a partner in
another cell only if it lies within the range of the boundary between the two pivots, and within
the range plus the cell's radius of its pivot; only there it is copied to. Of two cells the
one with the smaller number compares, so every pair meets once, and cells work on their own:
each is cut into blocks, and the copies into blocks, which are compared in separate groups.

Equal vectors are one class with a weight. Pairs are counted where they are found, and only a
spanning set of links goes on to the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kbcurate.llm.graph import components
from kbcurate.llm.minhash import _groups
from kbcurate.llm.store import Scratch, count_rows

COSINE = 0.9
#: Vectors of a cell, and of a block.
CELL, BLOCK = 4096, 4096
#: Pivots are broadcast; so many at most, 2 MB at 64 dimensions.
PIVOTS = 4096
#: Slack of the single-precision filters; what they let through is decided in double precision.
SLACK = 1e-4


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null or empty, all finite, not zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(embedding, lambda x: x != 0)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of one length as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    top = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / top  # neither overflow nor underflow of the squares
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _assign(pivots: np.ndarray | None):
    """Cell of each vector and its distance from the cell's pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, near = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, 2.0)
            if pivots is not None:
                fit = np.flatnonzero(batch.column("dim").to_numpy() == pivots.shape[1])
                if len(fit):
                    cosines = unit(matrix(batch.column("v").take(pa.array(fit)))) @ pivots.T
                    cell[fit] = np.argmax(cosines, axis=1)
                    near[fit] = np.sqrt(np.maximum(0, 2 - 2 * cosines[np.arange(len(fit)), cell[fit]]))
            yield batch.append_column("cell", pa.array(cell)).append_column("near", pa.array(near))
    return run


def _copies(pivots: np.ndarray | None, radii: dict[int, float], reach: float):
    """Cells of smaller number that may hold a partner of a vector; its own cell is listed too."""
    if pivots is not None:
        between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
        radius = np.array([radii.get(i, -3.0) for i in range(len(pivots))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            row, to = np.arange(batch.num_rows), cell
            fit = np.flatnonzero(batch.column("dim").to_numpy() == pivots.shape[1]) if pivots is not None else []
            if len(fit):
                own = cell[fit]
                cosines = unit(matrix(batch.column("v").take(pa.array(fit)))) @ pivots.T
                distance = np.sqrt(np.maximum(0, 2 - 2 * cosines))
                gap = cosines[np.arange(len(fit)), own][:, None] - cosines
                # distance to the boundary between two pivots: (d_j^2 - d_i^2) / (2 d_ij)
                open_ = gap <= (reach + SLACK) * between[own]
                open_ &= distance <= radius + reach + SLACK
                open_ &= np.arange(len(pivots)) < own[:, None]
                more, where = np.nonzero(open_)
                row, to = np.concatenate([row, fit[more]]), np.concatenate([to, where])
            names = ["id", "dim", "v", "w"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(pa.array(row)) for c in names], pa.array(to), pa.array(to == cell[row])],
                names=[*names, "cell", "native"],
            )
    return run


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the place of a row with the same label) after linking rows a with rows b."""
    while len(a):
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        if (x == y).all():
            break
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
    return label


def _join(cosine: float):
    """Weighted numbers of partners, and links that span what is connected, of each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _groups(batches, "grp"):
            grp = whole.column("grp").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]]))
            for begin, end in zip(starts, np.append(starts[1:], len(grp))):
                part = whole.slice(begin, end - begin)
                ids, weight = part.column("id").to_numpy(), part.column("w").to_numpy()
                left = part.column("left").to_numpy(zero_copy_only=False)
                twin = part.column("twin").to_numpy(zero_copy_only=False)
                vectors = unit(matrix(part.column("v")))
                short = vectors.astype(np.float32)
                a_rows, b_rows = np.flatnonzero(left), np.flatnonzero(~left)
                found, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
                same = bool(twin.any())  # a block with itself: all rows are left
                if same:
                    b_rows = a_rows
                for at in range(0, len(a_rows), 512):
                    some = a_rows[at:at + 512]
                    i, j = np.nonzero(short[some] @ short[b_rows].T >= cosine - SLACK)
                    a, b = some[i], b_rows[j]
                    if same:
                        a, b = a[a < b], b[a < b]
                    sure = np.zeros(len(a), bool)
                    for k in range(0, len(a), 1 << 15):
                        few = slice(k, k + (1 << 15))
                        sure[few] = np.einsum("ij,ij->i", vectors[a[few]], vectors[b[few]]) >= cosine
                    a, b = a[sure], b[sure]
                    np.add.at(found, a, weight[b])
                    np.add.at(found, b, weight[a])
                    label = _merge(label, a, b)
                some = np.flatnonzero((found > 0) | (label != np.arange(len(ids))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some]), pa.array(ids[label[some]]), pa.array(found[some])], names=["a", "b", "n"]
                )
    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, cell: int = CELL,
    block: int = BLOCK,
) -> DataFrame:
    """(id, n_links, component_id, kept) per row: how many other vectors have a cosine of at
    least ``cosine`` (double precision), and the smallest id reachable over such links.

    Null, empty or zero vectors, and those with null or non-finite components, link with nothing;
    vectors of different lengths do not link. Rows with a null id are kept without links; repeated
    rows of one id count as one vector; extra columns are ignored; an empty table gives no row.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    v = F.col(f"`{vector_col}`")
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"),
        F.when(usable(v), F.xxhash64(v, F.lit(1))).alias("k1"), F.when(usable(v), F.xxhash64(v, F.lit(2))).alias("k2"),
    )
    good = rows.where(F.col("id").isNotNull() & F.col("k1").isNotNull()).dropDuplicates(["id", "k1", "k2"])
    classes = scratch.write(good.groupBy("k1", "k2").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("w")))
    heads, seen = scratch.write(
        good.join(classes.select(F.col("class").alias("id"), "k1", "k2", "w"), ["id", "k1", "k2"])
        .select("id", F.size("v").alias("dim"), "v", "w"), count_rows(),
    )
    wanted = min(PIVOTS, seen["n"] // cell)
    pivots = None
    if wanted > 1:
        picked = heads.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(wanted).select("dim", "v").collect()
        dim = max({r["dim"] for r in picked}, key=[r["dim"] for r in picked].count)
        pivots = unit(np.array([r["v"] for r in picked if r["dim"] == dim], np.float64))
    kind = "id long, dim int, v array<float>, w long"
    if dict(heads.dtypes)["v"] != "array<float>":
        kind = kind.replace("array<float>", dict(heads.dtypes)["v"])
    assigned = scratch.write(heads.mapInArrow(_assign(pivots), f"{kind}, cell long, near double"))
    radii = {r["cell"]: r["far"] for r in assigned.groupBy("cell").agg(F.max("near").alias("far")).collect()}
    placed = scratch.write(
        assigned.select("id", "dim", "v", "w", "cell").mapInArrow(_copies(pivots, radii, reach), f"{kind}, cell long, native boolean")
    )

    # blocks of a cell's own vectors against each other and against the blocks of its copies
    numbers = placed.groupBy("dim", "cell").agg(
        F.ceil(F.sum(F.col("native").cast("long")) / block).alias("own"),
        F.ceil(F.sum((~F.col("native")).cast("long")) / block).alias("foreign"),
    )
    numbers = scratch.write(numbers.coalesce(1))
    dealt = placed.join(F.broadcast(numbers), ["dim", "cell"])  # one row per cell
    mine = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.when(F.col("native"), F.col("own")).otherwise(F.col("foreign"))))
    zero = F.lit(0).cast("long")

    def up_to(n: Column) -> Column:
        return F.when(n > 0, F.sequence(zero, n - 1)).otherwise(F.array().cast("array<long>"))

    def meeting(a: Column, b: Column, other: str, left: bool) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), F.lit(other).alias("other"), F.lit(left).alias("left"), F.lit(False).alias("twin"))

    dealt = dealt.withColumn("block", mine)
    at = F.col("block")
    # within a cell the pair of blocks (a, b) with a <= b; a block with itself is one list of rows
    own_pairs = F.transform(up_to(F.col("own")), lambda b: F.struct(
        F.least(at, b).alias("a"), F.greatest(at, b).alias("b"), F.lit("own").alias("other"),
        (at <= b).alias("left"), (at == b).alias("twin"),
    ))
    to_copies = F.transform(up_to(F.col("foreign")), lambda b: meeting(at, b, "copies", True))
    to_own = F.transform(up_to(F.col("own")), lambda a: meeting(a, at, "copies", False))
    meetings = F.when(F.col("native"), F.concat(own_pairs, to_copies)).otherwise(to_own)
    grouped = dealt.withColumn("m", F.explode(meetings)).select(
        F.xxhash64("dim", "cell", "m.a", "m.b", "m.other").alias("grp"), "id", "v", "w", "m.left", "m.twin"
    )
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.write(
        grouped.repartition(wide, "grp").sortWithinPartitions("grp").mapInArrow(_join(cosine), "a long, b long, n long")
    )
    scratch.drop(assigned, placed)

    links = found.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    joined = components(found).select(F.col("id").alias("class"), "component")
    named = scratch.write(
        classes.join(links, "class", "left").join(joined, "class", "left").select(
            "k1", "k2", (F.coalesce("others", F.lit(0)) + F.col("w") - 1).alias("n_links"),
            F.coalesce("component", "class").alias("component_id"),
        )
    )
    ids = rows.select("id", *[F.when(F.col("id").isNotNull(), F.col(k)).alias(k) for k in ("k1", "k2")])
    return ids.join(named, ["k1", "k2"], "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"),
    )
