"""Repeated byte strings by distributed prefix doubling.

A sparse suffix array: suffixes start at bytes picked by winnowing (the same ones wherever the same
``WINDOW + GRAM`` bytes stand), which cut a text into phrases of at most ``WINDOW`` bytes that overlap by a
gram; equal phrases in a row are one with a count, so that text with a short period has few. Ranks
of suffixes by their first phrase are doubled: Spark sorts the distinct pairs (rank, rank 2**l
phrases further on), a pair's place in that order is the new rank, and a position goes on only while its
rank is shared and its phrases do not reach past the threshold. Pairs are counted before they are
sorted, so a passage in a third of all texts is one row of the sort.

From the ranks every string of ``SIZE`` bytes is judged. Its whole phrases are an inner run, and with the
phrases at its ends an outer run; a run of any length is a pair of overlapping ranks.

* a string inside a stretch of one phrase that is longer by a period stands there twice;
* no shared rank for the inner run: the string is unique;
* an outer run that occurs again: the string does as well;
* else a repeat ends within its first or last phrase. Strings with the same inner run are compared
  by the bytes beyond it, one string for each outer run and all of those without a second.

Exact copies are one text from the start: all of them goes. Ends are compared by 64-bit hashes
within the runs of one 64-bit key, phrases by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kbcurate.llm.store import Scratch, count_rows
from kbcurate.llm.words import Rolling, mix, slices, sliding, to_long

SIZE = 400
GRAM, WINDOW = 16, 96
#: Bytes handled at once; longer texts are picked in pieces that overlap.
PIECE = 1 << 20

_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


#: Low bits of a key hold a place; pieces are shorter than that.
_PLACE = np.uint64((1 << 21) - 1)


def _picks(hashes: np.ndarray, window: int) -> np.ndarray:
    """Place of the least gram of every run of ``window`` grams, the last one of equals."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    keys = (hashes & ~_PLACE) | (_PLACE - np.arange(len(hashes), dtype=np.uint64))
    return (_PLACE - (sliding(keys, window, np.minimum) & _PLACE)).astype(np.int64)


def _grams(raw: np.ndarray, gram: int) -> tuple[Rolling, np.ndarray]:
    rolling = Rolling(_BYTES[raw])
    n = len(raw) - gram + 1
    if n <= 0:
        return rolling, np.zeros(0, np.uint64)
    return rolling, mix((rolling.sums[gram:] - rolling.sums[:-gram]) * rolling.down[:n])


def phrases_of(texts: list[bytes], gram: int, window: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text the picked positions, the first run that picks each, and the hash of each phrase: from
    the start to the first pick, between picks, and from the last one to the end. A phrase holds the
    gram it ends with. All texts have a run."""
    out: list = [None] * len(texts)
    held, size = [], 0
    for i, text in enumerate(texts):
        if len(text) > PIECE:
            out[i] = _long(text, gram, window)
            continue
        held.append(i)
        size += len(text)
        if size >= PIECE:
            _short(texts, held, out, gram, window)
            held, size = [], 0
    if held:
        _short(texts, held, out, gram, window)
    return out


def _changes(at: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))


def _short(texts, held, out, gram, window) -> None:
    raw = np.frombuffer(b"".join(texts[i] for i in held), np.uint8)
    ends = np.cumsum([len(texts[i]) for i in held])
    rolling, hashes = _grams(raw, gram)
    at = _picks(hashes, window)
    start = 0
    for i, end in zip(held, ends):
        mine = at[start:end - gram - window + 2]
        runs = _changes(mine)
        picks = mine[runs]
        hashes = rolling.spans(np.concatenate([[start], picks]), np.append(picks + gram, end))
        out[i] = picks - start, runs, _marked(hashes)
        start = end


def _long(text: bytes, gram: int, window: int):
    every = []
    runs = len(text) - gram - window + 2
    for begin in range(0, runs, PIECE):
        n = min(PIECE, runs - begin)
        _, hashes = _grams(np.frombuffer(text, np.uint8, n + window + gram - 2, begin), gram)
        at = _picks(hashes, window) + begin
        first = _changes(at)
        every.append((at[first], first + begin))
    at, first = (np.concatenate(x) for x in zip(*every))
    once = _changes(at)
    at, first = at[once], first[once]
    hashes = np.empty(len(at) + 1, np.uint64)
    low, high = np.concatenate([[0], at]), np.append(at + gram, len(text))
    for begin in range(0, len(hashes), PIECE // window):
        some = slice(begin, begin + PIECE // window)
        base = low[some][0]
        rolling = Rolling(_BYTES[np.frombuffer(text, np.uint8, high[some][-1] - base, base)])
        hashes[some] = rolling.spans(low[some] - base, high[some] - base)
    return at, first, _marked(hashes)


def _marked(hashes: np.ndarray) -> np.ndarray:
    """The first and the last phrase of a text equal only such phrases."""
    hashes[0] = mix(hashes[:1] + np.uint64(1))[0]
    hashes[-1] = mix(hashes[-1:] + np.uint64(2))[0]
    return hashes


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.flatten().to_numpy(zero_copy_only=False)


def _list_of(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _repeated(counts: np.ndarray) -> np.ndarray:
    """What a phrase that stands several times in a row adds to its hash."""
    return np.where(counts > 1, mix(counts.astype(np.uint64)), np.uint64(0))


def _cut_phrases(size: int, gram: int, window: int):
    """Per text: picked positions, the runs that pick them, phrases (hash with count, and the number of the
    first pick of each), and how many phrases from each one on can lie in one string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=PIECE):
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                at, runs, phrases, heads, reach = [], [], [], [], []
                for picks, first, found in phrases_of(texts, gram, window):
                    head = _changes(found)
                    counts = np.diff(np.append(head, len(found)))
                    start = np.concatenate([[0], picks])[head]
                    at.append(picks)
                    runs.append(first)
                    phrases.append((found[head] + _repeated(counts)).view(np.int64))
                    heads.append(head)
                    reach.append(np.searchsorted(start, start + size, side="right") - np.arange(len(head)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("tid"), pa.array([len(t) for t in texts], pa.int64()), _list_of(at, pa.int32()),
                     _list_of(runs, pa.int32()), _list_of(phrases, pa.int64()), _list_of(heads, pa.int32()),
                     _list_of(reach, pa.int32())],
                    names=["tid", "n", "picks", "runs", "phrases", "heads", "reach"],
                )
    return run


def _ranked(distinct: DataFrame, by: list[str]) -> DataFrame:
    """A rank per row that follows the order of ``by``."""
    return distinct.orderBy(*by).select(*by, F.monotonically_increasing_id().alias("rank"))


def _shuffled(keys: DataFrame) -> DataFrame:
    """Keys and lists that grow with the texts: joined by a shuffle at every size, so that none of them is
    broadcast, which takes several times their size in the driver."""
    return keys.hint("merge")


def double(phrases: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Per level l: (tid, x, rank) of the positions whose first 2**l phrases occur again."""
    def shared(rows: DataFrame, by: list[str], level: int) -> tuple[DataFrame, int]:
        again = scratch.write(_ranked(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).where("c > 1"), by))
        scratch.sweep()
        kept, found = scratch.write(
            rows.join(_shuffled(again), by).select("tid", "x", "reach", "rank"), count_rows()
        )
        scratch.drop(again)
        scratch.sweep()
        return kept, found["n"]

    first = phrases.select("tid", F.posexplode(F.arrays_zip("phrases", "reach")).alias("x", "p")).select(
        "tid", "x", F.col("p.phrases").alias("phrase"), F.col("p.reach").alias("reach")
    )
    now, n = shared(first, ["phrase"], 0)
    levels = [now]
    while n:
        step = 1 << (len(levels) - 1)
        ahead = Window.partitionBy("tid").orderBy("x").rangeBetween(step, step)
        pairs = now.withColumn("then", F.first("rank").over(ahead)).where(
            F.col("then").isNotNull() & (F.col("reach") >= 2 * step)
        ).select("tid", "x", "reach", F.col("rank").alias("r"), F.col("then"))
        pairs, seen = scratch.write(pairs, count_rows())
        if not seen["n"]:
            scratch.drop(pairs)
            break
        now, n = shared(pairs, ["r", "then"], len(levels))
        scratch.drop(pairs)
        levels.append(now)
    return levels


class _Phrases:
    """Phrases of all texts of a batch in a row: single ones by number, and those in a row that are equal
    as one with its count and ranks."""

    def __init__(self, batch: pa.RecordBatch, singles: np.ndarray):
        n = len(singles)
        self.before = np.concatenate([[0], np.cumsum(singles)])[:-1]  # single phrases of texts before
        bounds, phrases = _lists(batch.column("phrases"))
        _, heads = _lists(batch.column("heads"))
        self.text = np.repeat(np.arange(n), np.diff(bounds))
        self.head = self.before[self.text] + heads
        self.count = np.diff(np.append(self.head, singles.sum()))
        self.kind = phrases.view(np.uint64) - _repeated(self.count)
        self.of = np.repeat(np.arange(len(heads)), self.count)
        rows, flat = _lists_of_structs(batch.column("ranks"))
        owner = np.repeat(np.arange(n), np.diff(rows))
        level, x, rank = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("level", "x", "rank"))
        self.ranks = np.full((int(level.max(initial=0)) + 1, len(heads)), -1, np.int64)
        self.ranks[level, bounds[owner] + x] = rank

    def run_keys(self, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key of each run of ``c`` single phrases from ``x`` on, and whether the ranks of what lies
        between its first and its last phrase are shared."""
        first, last = self.of[x], self.of[x + c - 1]
        inside = last - first - 1
        held = inside > 0
        level = np.frexp(np.maximum(inside, 1))[1] - 1
        known = held & (level < len(self.ranks))
        level = np.where(known, level, 0)
        a = self.ranks[level, np.where(known, first + 1, 0)]
        b = self.ranks[level, np.where(known, last - (1 << level), 0)]
        alone = first == last
        begins = np.where(alone, c, self.head[first] + self.count[first] - x).astype(np.uint64)
        ends = np.where(alone, 0, x + c - self.head[last]).astype(np.uint64)
        odd, other = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
        key = mix(self.kind[first] + begins * odd)
        key = np.where(held, mix(key ^ (a.view(np.uint64) * other + inside.astype(np.uint64))), key)
        key = np.where(held, mix(key + b.view(np.uint64) * odd), key)
        key = np.where(alone, key, mix(key ^ (self.kind[last] + ends * other)))
        return key, ~held | (known & (a >= 0) & (b >= 0))


def _strings(size: int, gram: int, window: int):
    """Ranges of string starts with one inner and one outer run, where the inner run may repeat: (tid, p0,
    p1, left, right, inner, outer), inner bytes being ``[left, right)``; and ranges that are ``sure``.

    The inner run goes from the pick of a string's first run of grams to that of its last; what is
    picked between depends on the string alone. The outer run goes from the last pick not after
    the string's start to the first that ends not before its end.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            base = np.concatenate([[0], np.cumsum(n + 2 * size)])[:-1]
            bounds, picks = _lists(batch.column("picks"))
            _, runs = _lists(batch.column("runs"))
            many = np.diff(bounds)
            text = np.repeat(np.arange(len(n)), many)
            g, first = base[text] + picks, base[text] + runs  # of all texts in a row
            phrases = _Phrases(batch, many + 1)

            # stretches of one phrase: picks from head - 1 to head - 1 + count of the text, a period apart
            long = np.flatnonzero(phrases.count > 1)
            at = phrases.head[long] - phrases.text[long] - 1
            low, period = g[at], g[at + 1] - g[at]
            high = g[at + phrases.count[long]] + gram - size  # last string inside
            sure = high - low >= period
            low, dead, high, of_sure = low[sure], (low + period + 1)[sure], high[sure], phrases.text[long][sure]

            last, to = base + n - size, size - gram - window + 1
            cuts = np.concatenate([base, g, g + gram - size + 1, first, first - to])
            of = np.concatenate([np.arange(len(n)), text, text, text, text])
            cuts = np.unique(cuts[(cuts >= base[of]) & (cuts <= last[of])])
            within = np.searchsorted(dead, cuts, side="right") - 1
            if len(dead):
                cuts = cuts[(within < 0) | (cuts > high[np.maximum(within, 0)])]
                begin = dead[dead <= high]
                cuts = np.unique(np.concatenate([cuts, begin, high[high < last[of_sure]] + 1]))
                skip = np.isin(cuts, begin)
            else:
                skip = np.zeros(len(cuts), bool)
            of = np.searchsorted(base, cuts, side="right") - 1
            end = np.minimum(np.append(cuts[1:], np.iinfo(np.int64).max) - 1, last[of])
            cuts, of, end = cuts[~skip], of[~skip], end[~skip]
            i = np.searchsorted(first, cuts, side="right") - 1
            j = np.searchsorted(first, cuts + to, side="right") - 1
            inner, again = phrases.run_keys(i + 1 + of, j - i)
            cuts, end, of, i, j, inner = (v[again] for v in (cuts, end, of, i, j, inner))
            a = np.maximum(np.searchsorted(g, cuts, side="right") - 1, bounds[of] - 1)
            e = np.minimum(np.searchsorted(g, cuts + size - gram), bounds[of + 1])
            outer, twice = phrases.run_keys(a + 1 + of, e - a)
            begin = np.where(a >= bounds[of], g[np.maximum(a, 0)], base[of])
            outer = mix(outer + (cuts - begin).astype(np.uint64))
            zero = np.zeros(len(low), np.int64)
            every = np.concatenate([of, of_sure])
            columns = [
                np.concatenate([cuts, low]) - base[every], np.concatenate([end, high]) - base[every],
                np.concatenate([g[i] - base[of], zero]), np.concatenate([g[j] + gram - base[of], zero]),
                np.concatenate([inner.view(np.int64), zero]),
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("tid").take(pa.array(every)), *map(pa.array, columns),
                    pa.array(np.concatenate([outer.view(np.int64), zero]), mask=np.concatenate([~twice, zero == 0])),
                    batch.column("copied").take(pa.array(every)), pa.array(np.arange(len(every)) >= len(of)),
                ],
                names=["tid", "p0", "p1", "left", "right", "inner", "outer", "copied", "sure"],
            )
    return run


def _lists_of_structs(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.flatten()


def _ends(size: int):
    """Per string asked for, the hash of its bytes before and after its inner run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=PIECE):
                rows, asked = _lists_of_structs(part.column("asked"))
                fields = {c: asked.field(c).to_numpy() for c in ("p0", "p1", "left", "right", "inner")}
                for i, text in enumerate(part.column("text").cast(pa.large_binary()).to_pylist()):
                    mine = slice(rows[i], rows[i + 1])
                    p0, p1, left, right, inner = (v[mine] for v in fields.values())
                    order = np.argsort(p0, kind="stable")
                    for some in np.array_split(order, 1 + int((p1 - p0 + 1).sum()) // PIECE):
                        width = p1[some] - p0[some] + 1
                        of = np.repeat(some, width)
                        p = np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width) + p0[of]
                        low = int(p.min())
                        rolling = Rolling(_BYTES[np.frombuffer(text, np.uint8, int(p.max()) + size - low, low)])
                        before = rolling.spans(p - low, left[of] - low)
                        after = rolling.spans(right[of] - low, p + size - low)
                        ends = mix(before * np.uint64(0x9E3779B97F4A7C15) ^ after)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(p), part.column("tid")[i].as_py(), np.int64)), pa.array(p),
                             pa.array(inner[of]), to_long(ends)],
                            names=["tid", "p", "inner", "ends"],
                        )
    return run


def _merge(size: int):
    """Spans covered by the strings that start in the ranges of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows, ranges = _lists_of_structs(batch.column("ranges"))
            low, high = ranges.field("p0").to_numpy(), ranges.field("p1").to_numpy() + size
            spans = []
            for i in range(batch.num_rows):
                a, b = low[rows[i]:rows[i + 1]], high[rows[i]:rows[i + 1]]
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.concatenate([[True], a[1:] > b[:-1]])
                begin, end = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(begin, end)])
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(spans, kind)], names=["tid", "spans"])
    return run


def _keys(text):
    """Two 64-bit hashes of a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def remove_repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE
) -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct), n_bytes, n_removed, spans (byte positions
    ``[start, end)`` removed, maximal and in order) and kept (the remaining bytes).

    A byte goes if a string of ``size`` bytes that covers it also starts anywhere else, in the same
    text too; strings are judged on the input and do not cross texts. A null text is empty; texts
    shorter than ``size`` are kept. Each row is a text of its own, so repeated rows lose all they have, and
    ids, null ones too, decide nothing. An empty table gives an empty result; extra columns stay in ``row``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    text = F.col("text")
    plain = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")
    ).where(F.octet_length("text") >= size).select("id", "text", *_keys(text))
    texts, seen = scratch.write(
        plain.groupBy("t1", "t2", "id").agg(F.count(F.lit(1)).alias("m"))
        .groupBy("t1", "t2").agg(F.sum("m").alias("copies"), F.min(F.struct("id", "m")).alias("head"))
        .select("t1", "t2", (F.col("copies") > 1).alias("copied"), "head.id", "head.m",
                F.monotonically_increasing_id().alias("tid")),
        F.coalesce(F.max("m"), F.lit(0)).alias("most"),
    )

    def with_text(wanted: DataFrame) -> DataFrame:
        """One row of each wanted text, with it."""
        side = _shuffled(wanted.select(F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.col("id").alias("head"),
                                       *[c for c in wanted.columns if c not in ("t1", "t2", "id", "copied")]))
        found = plain.join(
            side, (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")) & F.col("id").eqNullSafe(F.col("head"))
        ).drop("t1", "t2", "u1", "u2", "id", "head")
        if seen["most"] == 1:
            return found.drop("m")
        return found.where("m = 1").union(found.where("m > 1").dropDuplicates(["tid"])).drop("m")

    phrases = scratch.write(
        with_text(texts).select("tid", "text").mapInArrow(
            _cut_phrases(size, GRAM, WINDOW), "tid long, n long, picks array<int>, runs array<int>, phrases array<long>, heads array<int>, reach array<int>"
        )
    )
    scratch.sweep()
    levels = double(phrases, scratch)
    every = None
    for level, rows in enumerate(levels):
        rows = rows.select("tid", F.struct(F.lit(level).alias("level"), "x", "rank").alias("r"))
        every = rows if every is None else every.union(rows)
    ranked = every.groupBy("tid").agg(F.collect_list("r").alias("ranks"))
    strings = scratch.write(
        phrases.drop("reach").join(_shuffled(texts.select("tid", "copied")), "tid").join(_shuffled(ranked), "tid", "left")
        .where(F.col("ranks").isNotNull() | (F.size("heads") <= F.size("picks")))  # or nothing in it repeats
        .mapInArrow(_strings(size, GRAM, WINDOW), "tid long, p0 long, p1 long, left long, right long, inner long, outer long, copied boolean, sure boolean")
    )
    scratch.drop(phrases, *levels)
    scratch.sweep()

    string = ["tid", "p0", "p1", "left", "right", "inner", "copied"]
    outer = scratch.write(
        strings.where(F.col("outer").isNotNull()).groupBy("outer")
        .agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*string)).alias("s"))
    )
    alone = ((F.col("c") == 1) & ~F.col("copied")).alias("alone")
    heads = outer.select("s.*", "c").union(
        strings.where(F.col("outer").isNull() & ~F.col("sure")).select(*string, F.lit(1).cast("long"))
    ).select(*string[:-1], alone)
    open_runs = heads.groupBy("inner").agg(F.count(F.lit(1)).alias("c"), F.max("alone").alias("any")).where(
        "c > 1 AND any"
    ).select("inner")
    asked = scratch.write(
        heads.join(_shuffled(open_runs), "inner", "left_semi").groupBy("tid")
        .agg(F.collect_list(F.struct(*string[1:-1])).alias("asked"))
    )
    scratch.sweep()
    ranges = ["tid", "p0", "p1"]
    certain = scratch.write(
        strings.where("sure AND NOT copied").select(*ranges).union(
            strings.where("NOT copied").join(_shuffled(outer.where("c > 1").select("outer")), "outer", "left_semi")
            .select(*ranges)
        )
    )
    scratch.drop(strings, outer)
    scratch.sweep()
    windows = scratch.write(
        with_text(texts.join(_shuffled(asked), "tid")).mapInArrow(
            _ends(size), "tid long, p long, inner long, ends long"
        )
    )
    again = scratch.write(
        windows.groupBy("inner", "ends").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("inner", "ends")
    )
    scratch.sweep()
    found = scratch.write(
        windows.join(_shuffled(again), ["inner", "ends"], "left_semi")
        .select("tid", F.col("p").alias("p0"), F.col("p").alias("p1"))
    )
    scratch.drop(asked, windows, again)
    scratch.sweep()
    spans = scratch.write(
        certain.union(found).groupBy("tid").agg(F.collect_list(F.struct("p0", "p1")).alias("ranges"))
        .mapInArrow(_merge(size), "tid long, spans array<struct<start: long, end: long>>")
    )
    scratch.drop(certain, found)
    gone = scratch.write(
        texts.join(_shuffled(spans), "tid", "left").where(F.col("copied") | F.col("spans").isNotNull())
        .select(F.col("t1").alias("u1"), F.col("t2").alias("u2"), "copied", "spans")
    )
    scratch.sweep()
    return _cut(docs, text_col, gone)


def _cut(docs: DataFrame, text_col: str, gone: DataFrame) -> DataFrame:
    text = F.col("row").getField(text_col)  # taken from the row, so that the shuffle carries it once
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", *_keys(text), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"))
    rows = rows.join(_shuffled(gone), (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")), "left")
    span = "array<struct<start: long, end: long>>"
    spans = (
        F.when(F.col("copied"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))))
        .otherwise(F.coalesce("spans", F.array().cast(span)))
    )
    zero = F.lit(0).cast("long")
    removed = F.aggregate("spans", zero, lambda acc, s: acc + s["end"] - s["start"])
    state = F.struct(F.lit(b"").alias("kept"), zero.alias("at"))

    def step(acc, s):
        piece = F.substring(raw, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.concat(acc["kept"], piece).alias("kept"), s["end"].alias("at"))

    kept = F.aggregate(
        "spans", state, step,
        lambda acc: F.concat(acc["kept"], F.substring(raw, (acc["at"] + 1).cast("int"), F.col("n_bytes").cast("int"))),
    )
    return rows.select("row", "n_bytes", spans.alias("spans")).select(
        "row", "n_bytes", removed.alias("n_removed"), "spans",
        F.when(F.size("spans") == 0, raw).otherwise(kept).alias("kept"),
    )
