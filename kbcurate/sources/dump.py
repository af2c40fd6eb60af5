"""Reading the entity dump: one JSON document per line of a large, splittable text file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from kbcurate.schemas import CLAIM_KEYS, dump_schema
from kbcurate.session import written

_BLANKS = " \t\r\n"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a dump, plain or ``.bz2`` (a splittable codec, so it is read in parallel as is)."""
    return spark.read.text(path)


def clean_lines(lines: DataFrame) -> DataFrame:
    """Entity texts: array brackets and blank lines dropped, one trailing comma removed. Both ends of a
    line are looked at first: to trim it or to search it for a pattern walks over all of it."""
    value = F.col("value")
    blank = reduce(Column.__or__, [end for c in _BLANKS for end in (value.startswith(c), value.endswith(c))])
    trimmed = lines.select(F.when(blank, F.btrim(value, F.lit(_BLANKS))).otherwise(value).alias("value"))
    return trimmed.where(~value.isin("", "[", "]")).select(
        F.when(value.endswith(","), F.substr(value, F.lit(1), F.length(value) - 1)).otherwise(value).alias("value")
    )


def parse_entities(
    lines: DataFrame, claim_keys: list[str] = CLAIM_KEYS, rejects: Observation | None = None
) -> DataFrame:
    """Entities of dump lines; lines that are no JSON object with an id are dropped.

    ``rejects``, when given, observes how many lines were read and how many had no id. The parsed
    line goes through a generator, past which no filter is pushed: each line is parsed once.
    """
    parsed = clean_lines(lines).select(
        F.inline(F.array(F.from_json("value", dump_schema(claim_keys))))
    )
    usable = F.coalesce(F.col("id"), F.lit("")) != ""
    if rejects is not None:
        parsed = parsed.observe(
            rejects, F.count(F.lit(1)).alias("lines"), F.count_if(~usable).alias("rejected")
        )
    return parsed.where(usable)


def entity_table(
    lines: DataFrame, claim_keys: list[str] = CLAIM_KEYS, rejects: Observation | None = None
) -> DataFrame:
    """Entities of dump lines as a written table. All imports read it several times, and then
    only the claim columns they use; the text is parsed once, and ``rejects`` has its counts."""
    return written(parse_entities(lines, claim_keys, rejects), "entities")
