"""Conversation prefix trie by a splitter skeleton.

Conversations are sorted by their path (the sequence of their turns) and dealt by range to shards.
A node of the trie - a distinct sequence of first turns - lies in one shard unless it is on the
path of a splitter, the first path of a shard. So:

1. splitters are drawn from the paths, and the trie of their paths, the skeleton, is broadcast;
2. each shard walks its sorted paths with a stack of open nodes and finishes every node off the
   skeleton by itself, in memory that follows the deepest path and the widest open node;
3. for the nodes on the skeleton a shard leaves partial aggregates, which are reduced by node and
   then summed up the skeleton, whose size is bounded by ``SKELETON``.

Equal paths are split between shards by conversation id, so a conversation that a third of all
others copy is spread like any other. SHA-256 has no partial form that can be merged; the ids that end
at a skeleton node come as texts of a few thousand bytes in ascending order and are hashed as a stream.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kbcurate.llm.store import Scratch, count_rows

#: Bytes of a turn in a path (an MD5 of role and text).
TURN = 16
#: Turns of a shard, at most this many shards, and nodes of the skeleton at most.
SHARD_TURNS, SHARDS, SKELETON = 200_000, 2_000, 1_000_000
#: Paths drawn per splitter.
DRAWN = 16
#: Bytes of an id text that a shard leaves for a skeleton node.
PIECE = 4_096

_PARTS = (
    "kind string, node long, depth long, least long, parent long, parent_least long, n_convs long, "
    "n_children long, n_leaves long, saved long, width long, ends string, shard int, piece int"
)
_NAMES = [c.split()[0] for c in _PARTS.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def rebuilt(conversations: DataFrame, conv: str, turn: str, role: str, text: str, shared: int, group: int) -> DataFrame:
    """(conv, path, widths): each conversation after its first turns are taken from its group's
    first one. A path is the MD5s of its turns; widths are their code points."""
    word = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    said = F.coalesce(F.col(f"`{role}`"), F.lit(""))
    key = F.md5(F.concat(F.length(said).cast("string"), F.lit(":"), said, word).cast("binary"))
    turns = conversations.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"),
        F.struct(F.col(f"`{turn}`").alias("turn"), key.alias("key"), F.length(word).alias("width")).alias("t"),
    )
    whole = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("own"))
    first = whole.where(F.col("conv") % group == 0).select(
        F.col("conv").alias("donor"), F.slice("own", 1, max(shared - 1, 1)).alias("lent")
    )
    take = F.crc32(F.col("conv").cast("string").cast("binary")) % shared
    rows = whole.withColumn("h", take.cast("int")).withColumn("donor", F.col("conv") - F.col("conv") % group)
    none = F.slice(F.col("own"), 1, 0)
    mine = F.when(F.col("h") < F.size("own"), F.slice("own", F.col("h") + 1, F.size("own"))).otherwise(none)
    head = F.when(F.col("h") > 0, F.slice("lent", F.lit(1), F.col("h"))).otherwise(none)
    out = rows.join(first, "donor", "left").select(
        "conv", F.concat(F.coalesce(head, none), mine).alias("turns")
    )
    return out.select(
        "conv", F.unhex(F.array_join("turns.key", "")).alias("path"), F.col("turns.width").alias("widths")
    )


def skeleton_of(paths: list[bytes]) -> tuple[dict[tuple[int, bytes], int], list[tuple[int, int, int]]]:
    """Numbers of the nodes of a trie of sorted paths, in preorder, by (parent, turn), and per node its
    depth, its parent (-1: none) and the last node of its subtree. The root is always node 0."""
    number: dict[tuple[int, bytes], int] = {}
    nodes = [[0, -1, 0]]
    for path in paths:
        parent = 0
        for end in range(TURN, len(path) + 1, TURN):
            step = parent, path[end - TURN:end]
            if step not in number:
                number[step] = len(nodes)
                nodes.append([end // TURN, parent, len(nodes)])
            parent = number[step]
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i][1]
        nodes[up][2] = max(nodes[up][2], nodes[i][2])
    return number, [tuple(n) for n in nodes]


def _deal(splitters):
    """The shard of every path: how many splitters do not come after it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = splitters.value
        for batch in batches:
            paths, convs = batch.column("path").to_pylist(), batch.column("conv").to_pylist()
            shard = [bisect.bisect_right(bounds, (p, c)) for p, c in zip(paths, convs)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), *batch.columns], names=["shard", *batch.schema.names]
            )
    return run


class _Node:
    __slots__ = ("number", "width", "least", "n", "children", "leaves", "saved", "ends", "pending", "piece", "ids")

    def __init__(self, number: int | None, width: int):
        self.number, self.width = number, width
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends = hashlib.sha256() if number is None else None
        self.ids, self.piece, self.pending = [], 0, []


class _Walk:
    """The open nodes of one shard, root first; finished rows gather in ``rows``."""

    def __init__(self, shard: int, number: dict[tuple[int, bytes], int]):
        self.shard, self.number = shard, number
        self.path, self.open, self.rows = b"", [_Node(0, 0)], []

    def row(self, kind: str, **values) -> None:
        self.rows.append({**values, "kind": kind, "shard": self.shard})

    def close(self, depth: int) -> None:
        """Close open nodes deeper than ``depth``."""
        while len(self.open) > depth + 1:
            node, at = self.open.pop(), len(self.open)
            self.finish(node, at, self.open[-1])

    def finish(self, node: _Node, depth: int, parent: _Node | None) -> None:
        if parent is not None:  # sums that a node hands up, finished or partial
            parent.n += node.n
            parent.least = node.least if parent.least is None else min(parent.least, node.least)
        if node.number is not None:
            self.leave(node)
            self.row(
                "partial", node=node.number, n_convs=node.n, least=node.least, n_children=node.children,
                n_leaves=node.leaves, saved=node.saved, width=node.width,
            )
            return
        leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.width
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved
        for child in node.pending:
            child["parent_least"] = node.least
            self.row("node", **child)
        done = dict(
            depth=depth, least=node.least, n_convs=node.n, n_children=node.children, n_leaves=leaves, saved=saved,
            ends=node.ends.hexdigest(),
        )
        if parent.number is None:
            parent.pending.append(done)
        else:
            self.row("node", **done, parent=parent.number)

    def leave(self, node: _Node) -> None:
        if node.ids:
            self.row("ends", node=node.number, piece=node.piece, ends=",".join(node.ids))
            node.piece, node.ids = node.piece + 1, []

    def add(self, path: bytes, conv: int, widths: list[int]) -> None:
        same, limit = 0, min(len(self.open) - 1, len(path) // TURN)
        while same < limit and self.path[same * TURN:(same + 1) * TURN] == path[same * TURN:(same + 1) * TURN]:
            same += 1
        self.close(same)
        for d in range(same, len(path) // TURN):
            on = self.number.get((self.open[-1].number, path[d * TURN:(d + 1) * TURN]))
            self.open.append(_Node(on, widths[d]))
        self.path = path
        end = self.open[-1]
        end.least = conv if end.least is None else min(end.least, conv)
        if end.number is None:
            end.ends.update(f"{',' if end.n else ''}{conv}".encode())
        else:
            end.ids.append(str(conv))
            if len(end.ids) * 20 >= PIECE:
                self.leave(end)
        end.n += 1

    def end(self) -> None:
        self.close(0)
        self.finish(self.open.pop(), 0, None)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    types = [_TYPES[c.split()[1]] for c in _PARTS.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, types)], names=_NAMES
    )


def _walk(skeleton):
    """Nodes and partial nodes of whole shards that come sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "path", "conv", "widths")]
            for shard, path, conv, widths in zip(*columns):
                if walk is None or walk.shard != shard:
                    if walk is not None:
                        walk.end()
                        yield _batch(walk.rows)
                    walk = _Walk(shard, skeleton.value)
                walk.add(path, conv, widths)
                if len(walk.rows) >= 4_096:
                    yield _batch(walk.rows)
                    walk.rows = []
        if walk is not None:
            walk.end()
            yield _batch(walk.rows)
    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the id texts of each node, which come in order."""
    now, ends = None, None
    for batch in batches:
        nodes, hashes = [], []
        for node, text in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if node != now:
                if now is not None:
                    nodes.append(now)
                    hashes.append(ends.hexdigest())
                now, ends = node, hashlib.sha256(text.encode())
            else:
                ends.update(f",{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(hashes, pa.string())], names=["node", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([ends.hexdigest()])], names=["node", "ends"])


def _splitters(paths: DataFrame, turns: int, deepest: int, shard_turns: int) -> list[tuple[bytes, int]]:
    """First paths of all shards but the first: even steps through paths drawn by a hash of their
    id. There are as many shards as shuffle partitions at least, and their number is bounded, also
    by the skeleton they make."""
    least = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = min(SHARDS, max(least, -(-turns // shard_turns)), max(1, SKELETON // max(deepest, 1)))
    if shards < 2:
        return []
    wanted = min(shards * DRAWN, max(shards, SKELETON // max(deepest, 1)))
    rows = paths.select("path", "conv").orderBy(F.xxhash64("conv"), "conv").limit(wanted).collect()
    drawn = sorted((bytes(r["path"]), r["conv"]) for r in rows)
    if not drawn:
        return []
    return sorted({drawn[len(drawn) * i // shards] for i in range(1, shards)})


def prefix_trie(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    shared: int = 6, group: int = 100, shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node.

    Each conversation is rebuilt first: ``crc32(id) % shared`` turns of its group's first
    conversation (id - id % group), then its own beyond as many. A node is a distinct sequence of
    (role, text) from the start, the conversations starting with it are its members.

    A null role or text is empty; a null turn comes first, and turns with one number are ordered by the MD5 of
    role and text; repeated rows are turns of their own. Rows with a null conversation id belong
    to no conversation. A conversation left without turns is a member of the root only. An empty
    table has no nodes; extra columns are ignored. A conversation's turns (16 bytes each) are held in one row.
    """
    spark = conversations.sparkSession
    sc = spark.sparkContext
    scratch = Scratch(spark, "trie")
    paths, seen = scratch.write(
        rebuilt(conversations, conv, turn, role, text, shared, group), count_rows(),
        F.coalesce(F.sum(F.size("widths") + 1), F.lit(0)).alias("turns"),
        F.coalesce(F.max(F.size("widths")), F.lit(0)).alias("deepest"),
    )
    splitters = _splitters(paths, seen["turns"], seen["deepest"], shard_turns)
    number, nodes = skeleton_of([p for p, _ in splitters])
    dealt = paths.mapInArrow(_deal(sc.broadcast(splitters)), f"shard int, {_types(paths)}")
    parts = scratch.write(
        dealt.repartition(max(len(splitters) + 1, 1), "shard").sortWithinPartitions("shard", "path", "conv")
        .mapInArrow(_walk(sc.broadcast(number)), _PARTS)
    )

    frame = spark.createDataFrame(
        [(i, d, p, last) for i, (d, p, last) in enumerate(nodes)], "node long, depth long, parent long, last long"
    )
    summed = parts.where("kind = 'partial'").groupBy("node").agg(
        F.sum("n_convs").alias("n_convs"), F.min("least").alias("least"), F.sum("n_children").alias("own_children"),
        F.sum("n_leaves").alias("own_leaves"), F.sum("saved").alias("own_saved"), F.max("width").alias("width"),
    )
    hashed = parts.where("kind = 'ends'").select("node", "shard", "piece", "ends").repartition("node") \
        .sortWithinPartitions("node", "shard", "piece").mapInArrow(_digest, "node long, ends string")
    inner = frame.where("parent >= 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("inner"))
    known = scratch.write(
        frame.join(summed, "node").join(inner, "node", "left").join(hashed, "node", "left").select(
            "node", "depth", "parent", "last", "n_convs", "least",
            (F.col("own_children") + F.coalesce("inner", F.lit(0))).alias("n_children"),
            (F.col("own_leaves") + F.when(F.col("own_children") + F.coalesce("inner", F.lit(0)) == 0, 1).otherwise(0))
            .alias("own_leaves"),
            (F.col("own_saved") + F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("width")).otherwise(0))
            .alias("own_saved"),
            F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends"),
        )
    )
    # a subtree of the skeleton is a run of preorder numbers; the skeleton is bounded, so one window holds it
    run = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = known.select(
        "node", F.sum("own_leaves").over(run).alias("leaves_to"), F.sum("own_saved").over(run).alias("saved_to"),
    )
    upper = known.select(
        F.col("node").alias("up"), F.col("least").alias("up_least")
    )
    total = known.join(sums, "node").join(
        sums.select(F.col("node").alias("last"), F.col("leaves_to").alias("l2"), F.col("saved_to").alias("s2")), "last"
    ).join(F.broadcast(upper), F.col("parent") == F.col("up"), "left").select(
        F.col("least").alias("conv_id"), "depth", F.col("up_least").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("l2") - F.col("leaves_to") + F.col("own_leaves")).alias("n_leaves"),
        (F.col("s2") - F.col("saved_to") + F.col("own_saved")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
    local = parts.where("kind = 'node'").join(F.broadcast(upper), F.col("parent") == F.col("up"), "left").select(
        F.col("least").alias("conv_id"), "depth", F.coalesce("parent_least", "up_least").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
    return local.unionByName(total)


def _types(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
