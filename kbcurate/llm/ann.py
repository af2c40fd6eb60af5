"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin
first.

The tree is fitted on a bounded sample; every vector is put into its leaf. With one more coordinate
that makes all vectors equally long, the nearest by distance are those of the largest inner
product. A query walks the tree with a priority queue of open branches and visits leaves in the
order of the queue. How many is calibrated: the sample is searched both ways, and the
number of visits is widened until the recall asked for is reached. Queries and leaves then
meet in a shuffle, leaf by leaf, a large leaf in several blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kbcurate.llm.minhash import _groups
from kbcurate.llm.store import Scratch, count_rows
from kbcurate.llm.vectors import matrix, usable

K = 20
#: Rows the tree is fitted on, at most, and vectors aimed at in a leaf.
SAMPLE, LEAF = 20_000, 512
BRANCHES = 8
#: Recall the visits are calibrated to, on so many queries of the sample.
RECALL, CALIBRATION = 0.97, 256
#: Vectors of a leaf that are scored in one group.
BLOCK = 4096
SEED = 7


class Tree:
    """Centres of every inner node; leaves are numbered from 0."""

    def __init__(self, rows: np.ndarray, leaves: int):
        self.centres: list[np.ndarray | None] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        rng = np.random.default_rng(SEED)
        # the largest nodes are split first, until there are as many leaves as asked for
        root = self._node()
        heap = [(-len(rows), root, np.arange(len(rows)))]
        done, count = [], 1
        while heap and count < leaves:
            size, node, mine = heapq.heappop(heap)
            parts = _kmeans(rows[mine], min(BRANCHES, leaves - count + 1), rng) if -size > 1 else None
            if parts is None:
                done.append(node)
                continue
            centres, labels = parts
            self.centres[node] = centres
            for i in range(len(centres)):
                child = self._node()
                self.children[node].append(child)
                heapq.heappush(heap, (-int((labels == i).sum()), child, mine[labels == i]))
            count += len(centres) - 1
        for node in sorted([*done, *(n for _, n, _ in heap)]):
            self.leaf[node] = self.leaves
            self.leaves += 1

    def _node(self) -> int:
        self.centres.append(None)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.leaf) - 1

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row, by the nearest centre at every level."""
        out, todo = np.zeros(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while todo:
            node, mine = todo.pop()
            if self.centres[node] is None:
                out[mine] = self.leaf[node]
                continue
            near = np.argmin(_distances(rows[mine], self.centres[node]), axis=1)
            todo += [(child, mine[near == i]) for i, child in enumerate(self.children[node]) if (near == i).any()]
        return out

    def visits(self, row: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves of the best-bin-first walk."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            while self.centres[node] is not None:
                far = _distances(row[None], self.centres[node])[0]
                best = int(np.argmin(far))
                for i, child in enumerate(self.children[node]):
                    if i != best:
                        heapq.heappush(queue, (float(far[i] - far[best]), child))
                node = self.children[node][best]
            out.append(self.leaf[node])
        return out


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(1)


def _kmeans(rows: np.ndarray, k: int, rng) -> tuple[np.ndarray, np.ndarray] | None:
    """Centres without empty ones, and labels; None if the rows can't be split."""
    distinct = np.unique(rows, axis=0)
    if len(distinct) < 2 or k < 2:
        return None
    centres = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(10):
        labels = np.argmin(_distances(rows, centres), axis=1)
        used = np.unique(labels)
        centres = np.array([rows[labels == i].mean(axis=0) for i in used])
    labels = np.argmin(_distances(rows, centres), axis=1)
    used, labels = np.unique(labels, return_inverse=True)
    return (centres[used], labels) if len(used) > 1 else None


def lifted(rows: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate that makes all rows as long as the longest."""
    rest = np.sqrt(np.maximum(0, longest**2 - (rows * rows).sum(axis=1)))
    return np.column_stack([rows, rest])


def asked(rows: np.ndarray) -> np.ndarray:
    return np.column_stack([rows, np.zeros(len(rows))])


def calibrate(tree: Tree, sample: np.ndarray, longest: float, k: int, recall: float) -> int:
    """Leaf visits that find ``recall`` of the ``k`` nearest of the sample's first rows in it."""
    queries = sample[:CALIBRATION]
    leaf = tree.assign(lifted(sample, longest))
    place = np.empty((len(queries), tree.leaves), np.int64)  # of each leaf in the query's walk
    for i, q in enumerate(asked(queries)):
        place[i, tree.visits(q, tree.leaves)] = np.arange(tree.leaves)
    score = queries @ sample.T
    score[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return tree.leaves
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    steps = np.take_along_axis(place, leaf[top], axis=1).ravel()
    return int(np.quantile(steps, recall, method="higher")) + 1


#: Rows a task holds before it keeps the best of each query only.
HELD = 500_000


def _score(k: int):
    """The nearest of each query among the leaves of a task: leaves of one task are merged there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for whole in _groups(batches, "grp"):
            grp = whole.column("grp").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]]))
            for begin, end in zip(starts, np.append(starts[1:], len(grp))):
                part = whole.slice(begin, end - begin)
                asks = part.column("ask").to_numpy(zero_copy_only=False)
                if asks.all() or not asks.any():
                    continue
                ids, rows = part.column("id").to_numpy(), matrix(part.column("v"))
                query_ids, queries, vec_ids, vectors = ids[asks], rows[asks], ids[~asks], rows[~asks]
                found = []
                for at in range(0, len(queries), 256):
                    rough = queries[at:at + 256] @ vectors.T
                    some = query_ids[at:at + 256]
                    rough[some[:, None] == vec_ids] = -np.inf
                    if len(vectors) > k:
                        edge = -np.partition(-rough, k - 1, axis=1)[:, k - 1:k]
                    else:
                        edge = np.full((len(some), 1), -np.finfo(float).max)
                    # ties, and what rounding of the product may order otherwise, stay in
                    i, j = np.nonzero((rough >= edge - 1e-9 * (1 + np.abs(edge))) & (rough > -np.inf))
                    exact = (queries[at + i] * vectors[j]).sum(axis=1)
                    order = np.lexsort((vec_ids[j], -exact, i))
                    i, j, exact = i[order], j[order], exact[order]
                    first = np.searchsorted(i, np.arange(len(some)))
                    kept = np.arange(len(i)) - first[i] < k
                    found.append((some[i[kept]], vec_ids[j[kept]], exact[kept]))
                held += found
                rows_held = sum(len(x[0]) for x in held)
                if rows_held > HELD:
                    held = [_best(held, k)]
                    if len(held[0][0]) > HELD // 2:
                        yield _rows(held[0])
                        held = []
        if held:
            yield _rows(_best(held, k))
    return run


def _best(held: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best rows of each query."""
    query, vec, score = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], vec[kept], score[kept]


def _rows(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])


def search(
    vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
    recall: float = RECALL, leaf: int = LEAF, sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row of ``queries`` among the
    rows of ``vectors`` with another id, by inner product in double precision; nearest first, ties
    to the smaller id; all of them if there are fewer.

    Null, empty or zero vectors, those with null or non-finite components, and null ids take no
    part, nor do vectors of another length than most of the sample; repeated rows of an id count
    once; extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector_col}`")
        return df.where(usable(v) & F.col(f"`{id_col}`").isNotNull()).select(
            F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")
        ).dropDuplicates(["id"])

    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows, seen = scratch.write(clean(vectors), count_rows(), F.coalesce(F.max(length), F.lit(0.0)).alias("longest"))
    asks = scratch.write(clean(queries))
    kind = "query_id long, rank int, vec_id long, score double"
    picked = [r["v"] for r in rows.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(sample).collect()]
    if not picked:
        return spark.createDataFrame([], kind)
    dims = [len(v) for v in picked]
    dim = max(sorted(set(dims)), key=dims.count)
    rows, asks = (df.where(F.size("v") == dim) for df in (rows, asks))
    fitted = np.array([v for v in picked if len(v) == dim], np.float64)
    longest = seen["longest"] * (1 + 1e-9)
    tree = Tree(lifted(fitted, longest), max(1, min(seen["n"] // leaf, len(fitted) // 8)))
    shared = spark.sparkContext.broadcast(tree)
    most = calibrate(tree, fitted, longest, k, recall)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = shared.value.assign(lifted(matrix(batch.column("v")), longest))
                yield batch.append_column("leaf", pa.array(at))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                paths = [shared.value.visits(q, most) for q in asked(matrix(some.column("v")))]
                row = np.repeat(np.arange(len(paths)), [len(p) for p in paths])
                yield some.take(pa.array(row)).append_column("leaf", pa.array(np.concatenate(paths).astype(np.int64)))

    typed = f"id long, v {dict(rows.dtypes)['v']}, leaf long"
    indexed = scratch.write(rows.mapInArrow(put, typed))
    sizes = scratch.write(
        indexed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).coalesce(1)
    )
    small = F.broadcast(sizes)  # one row per leaf
    held = indexed.join(small, "leaf").select(
        F.xxhash64("leaf", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("grp"), F.lit(False).alias("ask"), "id", "v"
    )
    visiting = asks.mapInArrow(walk, typed).join(small, "leaf").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    ).select(F.xxhash64("leaf", "block").alias("grp"), F.lit(True).alias("ask"), "id", "v")
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = held.union(visiting).repartition(wide, "grp").sortWithinPartitions("grp").mapInArrow(
        _score(k), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
