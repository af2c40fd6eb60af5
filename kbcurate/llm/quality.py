"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, per language: a corpus has no bound on its words, while orders of
characters are few and say as much about prose, markup, shouting or noise. Counts, continuation
counts, discounts and back-off weights are joins and aggregates of tables sharded by context.
The finished tables are written to the shared folder in shards of bounded size by the character
before the predicted one; a worker takes a batch of documents through one shard after another,
so its memory is bounded whatever the model's size, and adds up what each shard says.

Characters predict what is said again and again well, so a text also pays for each word that is a
repeat what that is worth in trusted text (``-log`` of its share of words), and for each that is not. A
repeat is a word equal to the one before it, or the last of ``LOOP`` words in a row that stood in the
text before, which makes loops of any length cost.

A document goes if its shrunk cost per character lies above its language's threshold: a quantile of
the costs of the trusted documents of that language, each scored by a model that did not see it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from kbcurate.llm.memory import tidy
from kbcurate.llm.store import Scratch, count_rows, sized
from kbcurate.llm.words import Rolling, hash_words, mix, slices, window_starts

ORDER = 4
#: Rows of a model shard, about 40 bytes each in a worker.
SHARD_ROWS = 2_000_000
#: Weight of the language's mean cost in a document's, in characters.
PRIOR = 200
#: Cost bins per nat; thresholds are exact to one of them.
BINS = 1000
#: Share of unseen trusted documents of a language at or below its threshold.
QUANTILE = 0.995

#: Words in a row that make a repeat if they stood in the text before.
LOOP = 4

#: Bytes of text handled at once; a character takes up to 100 bytes on the way.
SLICE = 2 << 20

START, END = "\u0002", "\u0003"
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """Folder of the tables, its number of shards, and the languages with trusted text."""

    folder: str
    shards: int
    order: int


def _padded(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ``order - 1`` starts and before an end; bounds."""
    head = START * (order - 1)
    whole = "".join([f"{head}{t}{END}" for t in texts])
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + order for t in texts), np.int64, len(texts))
    return codes, np.concatenate([[0], np.cumsum(sizes)])


def _by_language(part: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, list[str]]]:
    langs = np.array([x or "" for x in part.column("lang").to_pylist()], object)
    texts = part.column("text").to_pylist()
    for lang in sorted(set(langs)):
        rows = np.flatnonzero(langs == lang)
        yield lang, rows, [texts[i] or "" for i in rows]


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SLICE):
                for lang, _, texts in _by_language(part):
                    codes, bounds = _padded(texts, order)
                    letters, small = np.unique(codes, return_inverse=True)
                    inside = np.ones(len(codes), bool)
                    for k in range(order - 1):
                        inside[bounds[:-1] + k] = False  # a gram ends at a character or an end
                    last = np.flatnonzero(inside)
                    # letters of a slice are numbered densely, so a gram is one or two integers
                    width = max(1, int(len(letters) - 1).bit_length())
                    if width * order > 64:
                        letters, small, width = _crowded(codes, 64 // order)
                    key = np.zeros(len(last), np.uint64)
                    for k in range(order - 1, -1, -1):
                        key = key << np.uint64(width) | small[last - k].astype(np.uint64)
                    keys, times = np.unique(key, return_counts=True)
                    mask, columns = np.uint64((1 << width) - 1), []
                    for k in range(order - 1, -1, -1):
                        columns.append(letters[(keys >> np.uint64(k * width) & mask).astype(np.int64)])
                    raw = np.column_stack(columns).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                    grams = [raw[i:i + order] for i in range(0, len(raw), order)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams)), pa.array(grams, pa.string()), pa.array(times, pa.int64())],
                        names=["lang", "gram", "c"],
                    )
    return run


def _crowded(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A slice with more letters than ``width`` bits number: its rarest count as U+FFFD."""
    letters, small, times = np.unique(codes, return_inverse=True, return_counts=True)
    kept = np.sort(np.argsort(-times, kind="stable")[:(1 << width) - 1])
    number = np.full(len(letters), len(kept))
    number[kept] = np.arange(len(kept))
    return np.append(letters[kept], 0xFFFD), number[small], width


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): the modified discounts from the counts of counts."""
    n = {i: F.sum((F.col("c") == i).cast("long")) for i in (1, 2, 3, 4)}
    some = counts.groupBy("lang").agg(*[n[i].alias(f"n{i}") for i in n])
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))

    def d(i: int, low: float) -> Column:
        exact = i - F.try_divide((i + 1) * y * F.col(f"n{i + 1}"), F.col(f"n{i}"))
        good = (F.col("n1") > 0) & (F.col(f"n{i}") > 0) & (exact > 0) & (exact < i)
        return F.when(good, exact).otherwise(F.lit(low))

    return some.select("lang", d(1, 0.5).alias("d1"), d(2, 1.0).alias("d2"), d(3, 1.5).alias("d3"))


def gram_counts(trusted: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(lang, gram, c) of the texts of ``trusted``. Null texts count as empty, null languages as ``''``."""
    plain = trusted.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    return plain.mapInArrow(tidy(_count(order)), "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def train(trusted: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER) -> Model:
    """Model of the texts of ``trusted``."""
    return train_counts(gram_counts(trusted, lang_col, text_col, order), order)


def train_counts(grams: DataFrame, order: int = ORDER) -> Model:
    """Model of counted grams of the highest order."""
    scratch = Scratch(grams.sparkSession, "quality")
    counts, seen = scratch.write(grams, count_rows())
    tasks = max(6, -(-seen["n"] // 250_000))
    tables = {order: (counts, seen["n"])}
    for k in range(order - 1, 0, -1):
        lower = tables[k + 1][0].select("lang", F.expr("substring(gram, 2)").alias("gram")).groupBy("lang", "gram")
        table, seen = scratch.write(lower.agg(F.count(F.lit(1)).alias("c")).coalesce(tasks), count_rows())
        tables[k] = (table, seen["n"])

    parts, below = [], None
    for k in range(1, order + 1):
        table, n = tables[k]
        table = table.withColumn("context", F.expr(f"substring(gram, 1, {k - 1})"))
        d = scratch.write(_discounts(table).coalesce(1))
        c = F.col("c")
        discount = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        cut = table.join(F.broadcast(d), "lang").withColumn("d", discount)  # one row per language
        context, seen = scratch.write(
            cut.groupBy("lang", "context").agg(
                F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("backoff"), F.count(F.lit(1)).alias("v"),
            ).coalesce(tasks), count_rows(),
        )
        joined = cut.join(sized(context, seen["n"]), ["lang", "context"])
        own = (F.col("c") - F.col("d")) / F.col("total")
        if below is None:
            p = joined.select("lang", "gram", (own + F.col("backoff") / (F.col("v") + 1)).alias("p"))
            unknown = context.select("lang", F.lit(2).alias("kind"), F.lit("").alias("gram"), F.log(F.col("backoff") / (F.col("v") + 1)).alias("value"))
        else:
            under = below[0].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            p = joined.withColumn("suffix", F.expr("substring(gram, 2)")).join(
                sized(under, below[1]), ["lang", "suffix"]
            ).select("lang", "gram", (own + F.col("backoff") * F.col("q")).alias("p"))
        p = scratch.write(p.coalesce(tasks))
        below = (p, n)
        parts.append(p.select("lang", F.lit(0).alias("kind"), "gram", F.log("p").alias("value")))
        if k > 1:
            parts.append(context.select("lang", F.lit(1).alias("kind"), F.col("context").alias("gram"), F.log("backoff").alias("value")))
    parts.append(unknown)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    total = sum(n for _, n in tables.values())
    shards = max(1, -(-2 * total // SHARD_ROWS))
    # a row belongs where the character before the predicted one says; what has none belongs everywhere
    before = F.when(F.col("kind") == 1, F.expr("substring(gram, -1, 1)")).otherwise(F.expr("substring(gram, -2, 1)"))
    everywhere = (F.col("kind") == 2) | ((F.col("kind") == 0) & (F.length("gram") == 1))
    at = F.when(everywhere, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.ascii(before) % shards))
    folder = f"{scratch.base}/model"
    rows.withColumn("shard", F.explode(at)).coalesce(tasks).write.partitionBy("shard").parquet(folder)
    return Model(folder, shards, order)


def _keys(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the 0 to ``order`` characters up to each place (wrong across the array's start)."""
    keys, raw, power = [np.zeros(len(codes), np.uint64)], np.zeros(len(codes), np.uint64), np.uint64(1)
    wide = codes.astype(np.uint64) + np.uint64(1)
    for k in range(order):
        moved = np.zeros(len(codes), np.uint64)
        moved[k:] = wide[: len(codes) - k]
        raw = raw + moved * power
        power = power * _BASE
        keys.append(mix(raw + np.uint64(k + 1)))
    return keys


class _Shard:
    """Per language: sorted hashes and values of grams and of contexts, and the unknown's value."""

    def __init__(self, model: Model, shard: int):
        import pyarrow.dataset as ds
        from pyarrow import fs

        self.tables = {}
        system, root = fs.FileSystem.from_uri(model.folder)
        where = f"{root}/shard={shard}"
        if system.get_file_info(where).type == fs.FileType.NotFound:
            return  # nothing was trusted
        table = ds.dataset(where, filesystem=system, format="parquet").to_table()
        table = table.combine_chunks()
        langs, kinds = table.column("lang").to_numpy(), table.column("kind").to_numpy()
        values, grams = table.column("value").to_numpy(), table.column("gram").cast(pa.large_string())
        sizes = pc.utf8_length(grams).to_numpy()
        hashes = np.zeros(len(sizes), np.uint64)
        for k in range(1, model.order + 1):
            same = sizes == k
            if same.any():
                raw = _joined(grams.filter(pa.array(same))).encode("utf-32-le", "surrogatepass")
                hashes[same] = _keys(np.frombuffer(raw, np.uint32), k)[k][k - 1::k]
        del table, grams
        for lang in set(langs):
            mine, found = langs == lang, []
            for kind in (0, 1):
                rows = np.flatnonzero(mine & (kinds == kind))
                rows = rows[np.argsort(hashes[rows])]
                found.append((hashes[rows], values[rows]))
            unknown = values[mine & (kinds == 2)]
            self.tables[lang] = (*found, unknown[0] if len(unknown) else 0.0)


def _joined(column: pa.ChunkedArray) -> str:
    """All values in a row, without a Python string of each."""
    parts = []
    for chunk in column.chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset:chunk.offset + len(chunk) + 1]
        parts.append(chunk.buffers()[2][int(ends[0]):int(ends[-1])].to_pybytes())
    return b"".join(parts).decode("utf-8", "surrogatepass")


def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, values = table
    if not len(hashes):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return hashes[at] == keys, values[at]


def _log_probabilities(keys: list[np.ndarray], places: np.ndarray, order: int, tables) -> np.ndarray:
    grams, contexts, unknown = tables
    out, left = np.zeros(len(places)), np.arange(len(places))
    for k in range(order, 0, -1):
        hit, value = _look(grams, keys[k][places[left]])
        out[left[hit]] += value[hit]
        left = left[~hit]
        if not len(left):
            return out
        if k > 1:
            hit, value = _look(contexts, keys[k - 1][places[left] - 1])
            out[left[hit]] += value[hit]
    out[left] += unknown
    return out


def _repeats(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words after the first of each text, and how many of them are repeats: equal to the word before,
    or the last of ``LOOP`` words in a row that stood in the text before."""
    words = hash_words(texts)
    counts = words.counts
    doc = np.repeat(np.arange(len(counts)), counts)
    again = np.zeros(len(doc), bool)
    if len(doc):
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
        begin, of = window_starts(words.start, LOOP)
        grams = Rolling(words.hash).spans(begin, begin + LOOP)
        order = np.lexsort((begin, grams, of))
        known = np.zeros(len(order), bool)
        known[1:] = (grams[order[1:]] == grams[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
        again[begin[order[known]] + LOOP - 1] = True
    return np.maximum(counts - 1, 0), np.bincount(doc[again], minlength=len(counts))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(id, lang, n, logp, pairs, repeats) per row: predicted characters (the end included) and their
    summed log probability, words after the first and how many of them are repeats; logp is null in
    a language without trusted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, _Shard] = {}
        for batch in batches:
            for part in slices(batch, size=SLICE // 2):
                n, logp = np.ones(part.num_rows, np.int64), np.zeros(part.num_rows)
                known = np.zeros(part.num_rows, bool)
                pairs, repeats = _repeats(part.column("text"))
                for shard in range(model.shards):
                    if shard not in kept:
                        kept = {shard: _Shard(model, shard)}
                    for lang, rows, texts in _by_language(part):
                        tables = kept[shard].tables.get(lang)
                        codes, bounds = _padded(texts, model.order)
                        n[rows] = np.diff(bounds) - model.order + 1
                        if tables is None:
                            continue
                        known[rows] = True
                        places = np.ones(len(codes), bool)
                        for k in range(model.order - 1):
                            places[bounds[:-1] + k] = False
                        places = np.flatnonzero(places)
                        places = places[codes[places - 1] % model.shards == shard]
                        found = _log_probabilities(_keys(codes, model.order), places, model.order, tables)
                        sums = np.concatenate([[0.0], np.cumsum(found)])
                        ends = np.searchsorted(places, bounds)
                        logp[rows] += sums[ends[1:]] - sums[ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("lang"), pa.array(n), pa.array(logp, mask=~known),
                     pa.array(pairs, pa.int64()), pa.array(repeats, pa.int64())],
                    names=["id", "lang", "n", "logp", "pairs", "repeats"],
                )

    plain = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")
    )
    return plain.mapInArrow(tidy(run), "id long, lang string, n long, logp double, pairs long, repeats long")


def thresholds(trusted: DataFrame) -> DataFrame:
    """(lang, rate, mean, threshold) from scores of trusted documents: the share of words that are
    repeats, the mean cost per character, and the ``QUANTILE`` of shrunk costs."""
    rates = trusted.groupBy("lang").agg(((F.sum("repeats") + 0.5) / (F.sum("pairs") + 1)).alias("rate"))
    rated = trusted.join(F.broadcast(rates), "lang")  # one row per language
    means = rated.groupBy("lang").agg((-F.sum(whole()) / F.sum("n")).alias("mean"))
    binned = rated.join(F.broadcast(means), "lang").groupBy(  # one row per language
        "lang", "rate", "mean", F.ceil(shrunk() * BINS).cast("long").alias("bin")
    ).agg(F.count(F.lit(1)).alias("c"))
    along = Window.partitionBy("lang").orderBy("bin")
    share = F.sum("c").over(along) / F.sum("c").over(Window.partitionBy("lang"))
    return binned.withColumn("share", share).groupBy("lang", "rate", "mean").agg(
        (F.min(F.when(F.col("share") >= QUANTILE, F.col("bin"))) / BINS).alias("threshold")
    )


def whole() -> Column:
    """Log probability of a text's characters and of which of its words are repeats."""
    repeats, pairs, rate = F.col("repeats"), F.col("pairs"), F.col("rate")
    return F.col("logp") + repeats * F.log(rate) + (pairs - repeats) * F.log(1 - rate)


def shrunk() -> Column:
    """Cost per character, drawn to the language's mean where a text is short."""
    return (-whole() + PRIOR * F.col("mean")) / (F.col("n") + PRIOR)


def classify(
    docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text",
    order: int = ORDER,
) -> DataFrame:
    """(id, lang, n_chars, perplexity, cost, threshold, keep) per row of ``docs``.

    The model is trained on the documents whose id is in ``trusted_ids`` (column ``id``); thresholds
    come from two further models, each of one half of them by a hash of the id and scoring the other
    half; the counts of both halves add up to the model's (a language with one half only has the costs of the model that saw it). ``perplexity`` is of the
    characters alone. A text
    without characters has the cost of its end alone, shrunk to the mean, and stays; so does
    a document in a language without trusted text, with null figures. A null language is one of
    its own; null and repeated ids are scored like others; extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "classify")
    docs = docs.withColumn(lang_col, F.coalesce(F.col(f"`{lang_col}`"), F.lit("")))
    ids, seen = scratch.write(trusted_ids.select(F.col("id").cast("long").alias("id")).where("id IS NOT NULL").distinct(), count_rows())
    few = sized(ids.select(F.col("id").alias("_trusted")), seen["n"])
    trusted = scratch.write(docs.join(few, F.col(f"`{id_col}`").cast("long") == F.col("_trusted"), "left_semi").select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")
    ))
    half = F.xxhash64(F.col("id").cast("long")).bitwiseAND(F.lit(1))
    halves = [scratch.write(gram_counts(trusted.where(half == k), order=order)) for k in (0, 1)]
    all_counts = halves[0].union(halves[1]).groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    scored = scratch.write(scores(docs, train_counts(all_counts, order), id_col, lang_col, text_col))
    unseen = [
        scratch.write(scores(trusted.where(half == k), train_counts(halves[1 - k], order), "id").where("logp IS NOT NULL"))
        for k in (0, 1)
    ]
    scratch.drop(trusted, *halves)
    fitted = scratch.write(thresholds(unseen[0].union(unseen[1])).coalesce(1))
    seen_only = scored.join(sized(ids, seen["n"]), "id", "left_semi").where("logp IS NOT NULL")
    seen_only = seen_only.join(F.broadcast(fitted.select("lang")), "lang", "left_anti").select(scored.columns)
    limits = scratch.write(fitted.union(thresholds(seen_only)).coalesce(1))
    cost = shrunk()
    return scored.join(F.broadcast(limits), "lang", "left").select(  # one row per language
        "id", "lang", F.col("n").alias("n_chars"), F.exp(-F.col("logp") / F.col("n")).alias("perplexity"),
        cost.alias("cost"), "threshold", F.coalesce(cost <= F.col("threshold"), F.lit(True)).alias("keep"),
    )
