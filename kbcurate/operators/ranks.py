"""Ranks and groups that stay distributed when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def tie_break(*cols: str) -> Column:
    """A fixed pseudo-random order of rows that tie; its prefix splits them evenly."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))


def spread_rank(
    df: DataFrame, keys: list[str], steps: dict[str, Column], fine: list[Column], name: str
) -> DataFrame:
    """Row number within ``keys`` ordered by ``steps`` (name -> ascending sort value), then by
    ``fine``, without sorting a whole key in one task.

    Rows are counted per (keys, steps), the counts are summed along the steps - few rows per key -
    and only rows of one step are numbered together. Choose steps that split a key well, with a
    prefix of :func:`tie_break` as the last one.
    """
    names = [f"_s_{s}" for s in steps]
    rows = df.withColumns({n: v for n, v in zip(names, steps.values())})
    along = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
        .select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, *names])],
                F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, *names).orderBy(*fine)
    on = None
    for i, c in enumerate([*keys, *names]):
        same = F.col(c).eqNullSafe(F.col(f"_k{i}"))
        on = same if on is None else on & same
    return (
        rows.withColumn("_r", F.row_number().over(inside))
        .join(before, on)
        .select(*df.columns, (F.col("_before") + F.col("_r")).cast("long").alias(name))
    )


def gather(df: DataFrame, keys: list[str], item: Column, name: str) -> DataFrame:
    """Sorted array of ``item`` per key, one row each whatever its length. Only for groups that are
    bounded by what they are: the facts of one person, the labels of one dump document."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias(name))
