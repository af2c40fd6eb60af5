"""Mixing sources to target weights: blocks of equal size are apportioned by Sainte-Lague quotients,
first to sources, then to the shards of a source; a shard gives its share in a seeded order.

Everything is DataFrame code. Nothing is enumerated block by block: quotas are found around their
proportional value, as only seats there can be in question, and what a document gives follows from
its place in its shard's order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from kbcurate.llm.store import Scratch

WEIGHTS = (1, 2, 3)
REPEATS = 3
#: Words of a block; fewer if the smallest target is under 100 blocks.
BLOCK_WORDS = 64
#: A shard holds about so many words or rows.
SHARD_WORDS, SHARD_ROWS = 1_000_000, 20_000
SEED = "mix-1"

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``taken``: one row per document; ``sources`` and ``shards``: their targets and quotas."""

    taken: DataFrame
    sources: DataFrame
    shards: DataFrame


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Adds position, weight and target to (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share the total size; a target
    stops at ``repeats`` times its source's size, the excess being shared by the others. In order of
    size by weight the stopped ones come first, so a running sum gives the level at which
    the others stand.
    """
    named = sources.withColumn("position", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    listed = F.array(*[F.lit(w) for w in weights])
    named = named.withColumn("weight", F.element_at(listed, ((F.col("position") - 1) % len(weights) + 1).cast("int")))
    capped = named.withColumn("cap", F.col("source_size") * repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = Window.partitionBy()
    before = Window.orderBy("ratio", "position").rowsBetween(Window.unboundedPreceding, -1)
    levels = capped.withColumn(
        "level",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(whole)
    return levels.withColumn("final", level).withColumn(
        "target",
        F.when(F.col("ratio") > F.col("final"), F.col("final") * F.col("weight")).otherwise(F.col("cap").cast("double")),
    ).drop("cap", "ratio", "level", "final")


def apportion(rows: DataFrame, group: list[str], key: list[str], weight: str, limit: str, seats: str) -> DataFrame:
    """Adds ``quota``: the ``seats`` of each group (a column constant in it) dealt to its rows by the
    highest quotients weight / (2 k + 1), ties by ``key``, at most ``limit`` to a row.

    With s rows of positive weight, the common divisor lies within s / 2 seats of the proportional
    one, so a row's quota lies within weight share * s / 2 of its proportional seats; only
    those candidates are listed, about two rows for each row.
    """
    per = Window.partitionBy(*group)
    share = F.col(weight) / F.sum(weight).over(per)
    rows = rows.where(F.col(weight) > 0).withColumn("_share", share).withColumn(
        "_n", F.count(F.lit(1)).over(per)
    ).withColumn("_slack", F.col("_share") * F.col("_n") / 2 + 1)
    even = F.col("_share") * F.col(seats)
    rows = rows.withColumn(
        "_low", F.least(F.greatest(F.floor(even - F.col("_slack")), F.lit(0)), F.col(limit)).cast("long")
    ).withColumn("_high", F.least(F.ceil(even + F.col("_slack")), F.col(limit)).cast("long"))
    rows = rows.withColumn("_left", F.col(seats) - F.sum("_low").over(per))
    listed = rows.withColumn(
        "_k", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1)))
    )
    order = Window.partitionBy(*group).orderBy(
        F.desc_nulls_last(F.col(weight) / (2 * F.col("_k") + 1)), *[F.asc_nulls_last(k) for k in key], "_k"
    )
    won = (F.row_number().over(order) <= F.col("_left")) & F.col("_k").isNotNull()
    names = [c for c in rows.columns if not c.startswith("_")]
    return listed.withColumn("_won", won.cast("long")).groupBy(*names, "_low").agg(
        F.sum("_won").alias("_more")
    ).select(*names, (F.col("_low") + F.col("_more")).alias("quota"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED,
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS,
) -> Mix:
    """What a mix of the sources takes of every document.

    ``taken``: id, source, text_key (md5 of the text), size (words), source_size, target (of the
    source), taken (words, repeats counted) and its parts: ``copies`` whole ones and the first
    ``part`` words once more. A shard's documents stand in the order of a seeded md5 of id and
    text; its size is cut into equal blocks, and its quota takes the shard whole as often as it goes
    and then its first blocks. Null or empty texts have size 0 and give nothing; a null source is
    a source of its own; repeated rows are documents of their own; extra columns are ignored;
    an empty table gives an empty result. Same rows and seed, same mix.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    text = F.col(f"`{text_col}`")
    base = scratch.write(docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("text_key"), count_words(text).alias("size"),
    ).withColumn("draw", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), "text_key"))))
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    shards = F.ceil(F.greatest(F.col("source_size") / shard_words, F.col("rows") / shard_rows)).cast("long")
    whole = Window.partitionBy()
    block = F.greatest(F.lit(1), F.least(
        F.lit(block_words), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(whole) / 100)
    )).cast("long")
    aimed = targets(sums, weights, repeats).withColumn("shards", shards).withColumn("block", block)
    aimed = aimed.withColumn("seats", F.round(F.sum("source_size").over(whole) / F.col("block")).cast("long"))
    # rounding to shards may leave room of half a block in each, so limits are set per shard only
    aimed = aimed.withColumn("limit", F.lit((1 << 62)).cast("long")).withColumn("one", F.lit(1))
    source_quota = scratch.write(
        aimed.join(
            apportion(aimed, ["one"], ["position"], "target", "limit", "seats").select("position", "quota"), "position", "left"
        ).select(
            "source", "position", "weight", "source_size", "target", "shards", "block",
            F.coalesce("quota", F.lit(0)).cast("long").alias("quota"),
        )
    )

    same = base["source"].eqNullSafe(source_quota["source"])
    placed = scratch.write(
        base.join(source_quota, same).select(
            "id", base["source"], "text_key", "size", "draw", "position", "source_size", "target",
            F.pmod(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long"), F.col("shards")).alias("shard"),
        )
    )
    by_shard = placed.groupBy("position", "shard").agg(F.sum("size").alias("shard_size")).join(
        source_quota.select("position", "block", F.col("quota").alias("source_quota")), "position"
    ).withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("shard_size") / F.col("block"))).cast("long"))
    by_shard = by_shard.withColumn("limit", F.col("blocks") * repeats)
    shard_quota = scratch.write(
        apportion(by_shard, ["position"], ["shard"], "shard_size", "limit", "source_quota")
        .select("position", "shard", "shard_size", "blocks", "quota")
    )

    order = Window.partitionBy("position", "shard").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("end")
    cut = F.floor((F.col("quota") % F.col("blocks")) * F.col("shard_size") / F.col("blocks"))
    part = F.greatest(F.lit(0), F.least(end, cut) - (end - F.col("size"))).cast("long")
    copies = F.floor(F.col("quota") / F.col("blocks")).cast("long")
    taken = placed.withColumn("end", F.sum("size").over(order)).join(shard_quota, ["position", "shard"], "left").select(
        "id", "source", "text_key", "size", "source_size", "target",
        F.coalesce(copies, F.lit(0)).alias("copies"), F.coalesce(part, F.lit(0)).alias("part"),
    ).withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
    return Mix(taken, source_quota, shard_quota)


def mixed_documents(docs: DataFrame, found: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, then one row of the first words (joined
    by one space) where it takes a part. Rows of which it takes nothing are gone, null and empty texts
    among them. Rows with the same id (null too) and text are one: what the mix takes of all of
    them stands in one of their rows. Extra columns, whatever their names, are kept."""
    given = found.taken.where(F.col("taken") > 0).groupBy("id", "text_key").agg(
        F.sum("copies").alias("copies"), F.collect_list(F.when(F.col("part") > 0, F.col("part"))).alias("parts"),
        F.count(F.lit(1)).alias("n"),
    ).select(F.col("id").alias("wanted"), "text_key", "copies", "parts", "n")
    text = F.col(f"`{text_col}`")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"),
        text.alias("text"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("key"),
    )
    joined = keyed.join(given, F.col("id").eqNullSafe(F.col("wanted")) & (F.col("key") == F.col("text_key")))
    rows = joined.where("n = 1").unionByName(joined.where("n > 1").dropDuplicates(["id", "key"]))
    take = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("copies").cast("int")), F.col("parts"))
    rows = rows.select("row", "text", F.explode(take).alias("take"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    cut = F.when(F.col("take") >= 0, F.array_join(F.slice(words, F.lit(1), F.col("take").cast("int")), " ")).otherwise(F.col("text"))
    return rows.select(*[
        cut.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns
    ])
