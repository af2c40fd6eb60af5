"""Class closures over the entity graph and the cleanup that rests on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from kbcurate.schemas import ENTITY_TYPES, INSTANCE_OF, SUBCLASS_OF, EntityType
from kbcurate.session import scratch_path, written, written_counted

# A frontier of at most this many ids is broadcast (under 100 MB of ids); a larger one is
# shuffled, and adaptive execution splits the edges of a hot parent.
BROADCAST_IDS = 1_000_000


def _ids(df: DataFrame) -> DataFrame:
    return df.select("wikidata_id")


def descendants(
    entities: DataFrame, edges: DataFrame, roots: list[str] | DataFrame, relation: str = SUBCLASS_OF
) -> DataFrame:
    """Everything below the roots over one relation, the roots included.

    Only roots that exist as entities start; edges of deleted relations are followed as well.
    Breadth-first: each round joins the new ids with the edges and drops those already seen, so
    diamonds and cycles end. Every round is one job that writes its ids to the shared folder: the
    lineage stays one round long whatever the depth, a lost executor costs no earlier round, and
    the row count observed on the way out decides how the next round joins and when to stop.
    """
    spark = entities.sparkSession
    if isinstance(roots, DataFrame):
        start = entities.join(_ids(roots), "wikidata_id", "left_semi")
    else:
        start = entities.where(F.col("wikidata_id").isin(list(roots)))
    pairs = written(
        edges.where(F.col("relation_type") == relation)
        .select("parent_entity_id", F.col("child_entity_id").alias("wikidata_id")),
        "edges",
    )
    base = scratch_path(spark, "closure")
    frontier = _ids(start).distinct()
    schema = frontier.schema
    rounds: list[str] = []
    while True:
        path = f"{base}/{len(rounds)}"
        count = written_counted(frontier, path)
        rounds.append(path)
        if not count:
            return spark.read.schema(schema).parquet(*rounds)
        side = spark.read.schema(schema).parquet(path).withColumnRenamed(
            "wikidata_id", "parent_entity_id"
        )
        if count <= BROADCAST_IDS:
            side = F.broadcast(side)
        frontier = (
            pairs.join(side, "parent_entity_id", "left_semi").select("wikidata_id").distinct()
            .join(spark.read.schema(schema).parquet(*rounds), "wikidata_id", "left_anti")
        )


def closures(
    entities: DataFrame, edges: DataFrame, roots: DataFrame, relation: str = SUBCLASS_OF
) -> DataFrame:
    """(tag, wikidata_id): :func:`descendants` of many root sets ``(tag, wikidata_id)`` in one run of
    rounds; the edges are written once."""
    spark = entities.sparkSession
    pairs = written(
        edges.where(F.col("relation_type") == relation)
        .select("parent_entity_id", F.col("child_entity_id").alias("wikidata_id")),
        "edges",
    )
    base = scratch_path(spark, "closures")
    frontier = roots.select("tag", "wikidata_id").distinct().join(_ids(entities), "wikidata_id", "left_semi")
    schema = frontier.schema
    rounds: list[str] = []
    while True:
        path = f"{base}/{len(rounds)}"
        count = written_counted(frontier, path)
        rounds.append(path)
        if not count:
            return spark.read.schema(schema).parquet(*rounds)
        side = spark.read.schema(schema).parquet(path).withColumnRenamed("wikidata_id", "parent_entity_id")
        if count <= BROADCAST_IDS:
            side = F.broadcast(side)
        frontier = (
            pairs.join(side, "parent_entity_id").select("wikidata_id", "tag").distinct()
            .join(spark.read.schema(schema).parquet(*rounds), ["wikidata_id", "tag"], "left_anti")
        )


def class_sets(entities: DataFrame, edges: DataFrame, types: dict[str, EntityType] = ENTITY_TYPES) -> DataFrame:
    """(type, class_id, ignored) for all configured types: classes below a type's roots and not below
    one it ignores, and the ignored ones. Roots and ignored branches close in one loop."""
    rows = [
        (f"{kind}{name}", qid)
        for name, t in types.items() for kind, ids in (("+", t.roots), ("-", t.ignore)) for qid in ids
    ]
    roots = entities.sparkSession.createDataFrame(rows, "tag string, wikidata_id string")
    closed = closures(entities, edges, roots).select(
        F.expr("substring(tag, 2)").alias("type"), F.col("wikidata_id").alias("class_id"),
        F.col("tag").startswith("-").alias("ignored"),
    )
    ignored = closed.where(F.col("ignored"))
    inside = closed.where(~F.col("ignored")).join(ignored.select("type", "class_id"), ["type", "class_id"], "left_anti")
    return inside.unionByName(ignored)


def class_set(
    entities: DataFrame, edges: DataFrame, roots: list[str], ignore: list[str] | None = None
) -> DataFrame:
    """Descendants of the roots that are not descendants of an ignored class."""
    inside = descendants(entities, edges, roots)
    if not ignore:
        return inside
    return inside.join(descendants(entities, edges, ignore), "wikidata_id", "left_anti")


def ignored_set(entities: DataFrame, edges: DataFrame, ignore: list[str]) -> DataFrame:
    return descendants(entities, edges, ignore)


def outside_hierarchy(
    typed: DataFrame, edges: DataFrame, inside: DataFrame, ignored: DataFrame | None = None
) -> DataFrame:
    """Typed ids with no class edge into ``inside``, or with one into ``ignored``.

    One pass over the class edges; the verdict per child is a map-side combined aggregate.
    """
    classes = inside.select(
        F.col("wikidata_id").alias("parent_entity_id"), F.lit(False).alias("bad")
    )
    if ignored is not None:
        classes = classes.union(ignored.select("wikidata_id", F.lit(True)))
    verdict = (
        edges.where(F.col("relation_type").isin(INSTANCE_OF, SUBCLASS_OF))
        .select("parent_entity_id", F.col("child_entity_id").alias("wikidata_id"))
        .join(classes, "parent_entity_id")
        .groupBy("wikidata_id")
        .agg(F.bool_or(~F.col("bad")).alias("inside"), F.bool_or("bad").alias("ignored"))
    )
    fine = verdict.where(F.col("inside") & ~F.col("ignored"))
    return _ids(typed).join(fine, "wikidata_id", "left_anti")


def evaluation_counts(evaluations: DataFrame) -> DataFrame:
    return evaluations.groupBy("property_id").agg(F.count(F.lit(1)).alias("evaluations"))


def preview_outside(
    typed: DataFrame, outside: DataFrame, facts: DataFrame, evaluations: DataFrame,
    fact_type: str | None,
) -> DataFrame:
    """One row of cleanup counts. A fact with several evaluations counts once per evaluation in
    ``properties_deleted`` and ``properties_extracted``, once in ``properties_evaluated``.

    Every input is reduced to partial counts on its own; the last aggregate adds them up.
    """
    counters = [
        "entities_removed", "total_entities", "deleted_rows", "extracted_rows", "evaluated_rows",
        "live_rows",
    ]

    def partial(df: DataFrame, **sums: Column) -> DataFrame:
        return df.select(
            *[sums.get(c, F.lit(0)).cast("long").alias(c) for c in counters]
        ).groupBy().agg(*[F.sum(c).alias(c) for c in counters])

    one = F.lit(1)
    parts = partial(outside, entities_removed=one).union(partial(typed, total_entities=one))
    if fact_type:
        mine = facts.where((F.col("type") == fact_type) & F.col("deleted_at").isNull())
        hit = (
            mine.join(outside.withColumnRenamed("wikidata_id", "entity_id"), "entity_id", "left_semi")
            .select("id", "statement_id")
            .join(evaluation_counts(evaluations).withColumnRenamed("property_id", "id"), "id", "left")
        )
        rows = F.greatest(F.coalesce("evaluations", F.lit(0)), one)
        extracted = F.col("statement_id").isNull()
        parts = parts.union(
            partial(
                hit, deleted_rows=rows, extracted_rows=F.when(extracted, rows).otherwise(0),
                evaluated_rows=(extracted & F.col("evaluations").isNotNull()).cast("int"),
            )
        ).union(partial(mine, live_rows=one))
    total = parts.groupBy().agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])
    some = F.col("entities_removed") > 0

    def shown(c: str) -> Column:
        return F.when(some, F.col(c)).otherwise(F.lit(0)).cast("long")

    return total.select(
        "entities_removed", "total_entities",
        shown("deleted_rows").alias("properties_deleted"),
        shown("live_rows").alias("properties_total"),
        shown("extracted_rows").alias("properties_extracted"),
        shown("evaluated_rows").alias("properties_evaluated"),
    )


def percent(part: Column, total: Column) -> Column:
    """Share in percent, 0 of nothing."""
    return F.when(total > 0, part * 100.0 / total).otherwise(F.lit(0.0))


def with_percentages(preview: DataFrame) -> DataFrame:
    return preview.withColumn(
        "removed_percent", percent(F.col("entities_removed"), F.col("total_entities"))
    ).withColumn(
        "deleted_percent", percent(F.col("properties_deleted"), F.col("properties_total"))
    )


@dataclass(frozen=True)
class Cleanup:
    kept: DataFrame
    facts: DataFrame
    index_deletes: DataFrame


def cleanup_outside(
    typed: DataFrame, outside: DataFrame, facts: DataFrame, fact_type: str | None, at: Column
) -> Cleanup:
    """Drop outside rows of a typed table, soft-delete live facts of its type that point at them,
    and list the ids to delete from the search index."""
    if fact_type:
        marks = outside.select(F.col("wikidata_id").alias("entity_id"), F.lit(True).alias("_gone"))
        doomed = (
            F.col("_gone").isNotNull() & (F.col("type") == fact_type) & F.col("deleted_at").isNull()
        )
        facts = facts.join(marks, "entity_id", "left").withColumn(
            "deleted_at", F.when(doomed, at).otherwise(F.col("deleted_at"))
        ).select(*facts.columns)
    return Cleanup(
        typed.join(outside, "wikidata_id", "left_anti"), facts, _ids(outside).distinct()
    )


def orphans(
    entities: DataFrame, typed: list[DataFrame], source_languages: DataFrame, facts: DataFrame,
    relations: DataFrame,
) -> DataFrame:
    """Entities nothing refers to: in no typed table, no source language, no fact, and no parent
    of a typed entity."""
    tabled = _ids(typed[0])
    for df in typed[1:]:
        tabled = tabled.union(_ids(df))
    tabled = tabled.distinct()
    parents = relations.join(
        tabled.withColumnRenamed("wikidata_id", "child_entity_id"), "child_entity_id", "left_semi"
    ).select(F.col("parent_entity_id").alias("wikidata_id"))
    keep = (
        tabled
        .union(source_languages.select("language_id"))
        .union(facts.where(F.col("entity_id").isNotNull()).select("entity_id"))
        .union(parents)
        .distinct()
    )
    return _ids(entities).join(keep, "wikidata_id", "left_anti")
