"""Connected components of a table of links, in rounds of star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kbcurate.llm.store import Scratch


#: Links a task of a round handles.
LINKS_PER_TASK = 250_000


def _least(pairs: DataFrame, scratch: Scratch, tasks: int) -> DataFrame:
    """The least v of each u, a map-side combined aggregate; written, so that the join with it has
    two plain inputs and a hot u is split by adaptive execution."""
    return scratch.write(pairs.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks))


def _done(pairs: DataFrame) -> bool:
    """Whether all links are stars: every u has one v, and no v is a u."""
    ends = pairs.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(
        pairs.select("v", F.lit(0), F.lit(1))
    )
    wrong = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where(
        F.col("up") + F.col("root") > 1
    )
    return wrong.isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id in ``links`` the smallest id it is connected with.

    Alternates large-star and small-star contractions (Kiveris et al., 2014): each round points
    neighbours at the least neighbour, the number of links never grows, and it ends when all
    links are stars around the least id. A round is written to the shared folder, in as many
    parts as its links need, and the one before removed. Nulls and self-links are left out;
    repeated links are harmless.
    """
    scratch = Scratch(links.sparkSession, "components")
    high, low = F.greatest(a, b), F.least(a, b)
    size = F.count(F.lit(1)).alias("n")
    now, seen = scratch.write(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(high.alias("u"), low.alias("v")).distinct(), size,
    )
    while True:
        tasks = max(6, -(-2 * seen["n"] // LINKS_PER_TASK))
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = _least(both, scratch, tasks)
        large = scratch.write(
            both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct().coalesce(tasks)
        )
        scratch.drop(least, now)
        least = _least(large, scratch, tasks)
        small = large.join(least, "u").select(
            F.explode(F.array(
                F.struct(F.col("u"), F.col("m").alias("v")),
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            )).alias("e")
        ).select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct().coalesce(tasks)
        now, seen = scratch.write(small, size)
        scratch.drop(least, large)
        if _done(now):
            break
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
