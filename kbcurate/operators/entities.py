"""Row operators over parsed dump entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kbcurate.functions import claims as C
from kbcurate.schemas import RELATION_TYPES

# Sites that look like language editions but are not.
NOT_EDITIONS = ["commonswiki", "simplewiki"]


def names(entities: DataFrame) -> DataFrame:
    return entities.select(
        F.col("id").alias("wikidata_id"),
        C.best_text(F.col("labels")).alias("name"),
        C.best_text(F.col("descriptions")).alias("description"),
    )


def label_rows(entities: DataFrame) -> DataFrame:
    """One row per entity and distinct label."""
    return entities.select(
        F.col("id").alias("entity_id"), F.explode(C.all_labels(F.col("labels"))).alias("label")
    )


def truthy_claims(entities: DataFrame, props: list[str]) -> DataFrame:
    """One row per truthy claim of the given properties."""

    def rows(prop: str) -> Column:
        return F.transform(
            C.truthy(F.col("claims"), prop),
            lambda c: F.struct(
                F.lit(prop).alias("prop"), c["id"].alias("statement_id"),
                F.coalesce(c["rank"], F.lit("normal")).alias("rank"),
                C.claim_entity(c).alias("value_id"), C.claim_date(c).alias("date"),
                C.claim_value(c).alias("value"),
                c["qualifiers"].alias("qualifiers_json"), c["references"].alias("references_json"),
            ),
        )

    return entities.select(
        F.col("id").alias("entity_id"), F.explode(F.concat(*[rows(p) for p in props])).alias("c")
    ).select("entity_id", "c.*")


def class_rows(entities: DataFrame) -> DataFrame:
    """One row per entity and class it is an instance or subclass of."""
    return entities.select(
        F.col("id").alias("entity_id"), F.explode(C.class_ids(F.col("claims"))).alias("class_id")
    )


def extract_relations(entities: DataFrame) -> DataFrame:
    """One row per truthy claim of the tracked types; claims lacking item or id are skipped."""

    def rows(relation: str) -> Column:
        return F.transform(
            C.truthy(F.col("claims"), relation),
            lambda c: F.struct(
                C.claim_entity(c).alias("parent_entity_id"),
                F.lit(relation).alias("relation_type"), c["id"].alias("statement_id"),
            ),
        )

    return (
        entities.select(
            F.col("id").alias("child_entity_id"),
            F.explode(F.concat(*[rows(r) for r in RELATION_TYPES])).alias("r"),
        )
        .select("r.parent_entity_id", "child_entity_id", "r.relation_type", "r.statement_id")
        .where(F.col("parent_entity_id").isNotNull() & F.col("statement_id").isNotNull())
    )


def parent_ids(entities: DataFrame) -> DataFrame:
    """Distinct items any tracked relation points at, whether or not the claim has an id."""
    ids = F.concat(*[C.entity_ids(F.col("claims"), p) for p in RELATION_TYPES])
    return entities.select(F.explode(F.array_distinct(ids)).alias("wikidata_id")).distinct()


def sitelink_urls(entities: DataFrame) -> DataFrame:
    """One row per language edition an entity has a page in: its address and address prefix."""
    sites = F.map_entries(F.col("sitelinks"))
    links = entities.select(F.col("id").alias("wikidata_id"), F.explode(sites).alias("s")).where(
        F.col("s.key").endswith("wiki") & ~F.col("s.key").isin(NOT_EDITIONS)
        & F.col("s.value.title").isNotNull()
    )
    prefix = F.concat(
        F.lit("https://"), F.replace(F.col("s.key"), F.lit("wiki"), F.lit("")),
        F.lit(".wikipedia.org"),
    )
    title = F.replace(F.col("s.value.title"), F.lit(" "), F.lit("_"))
    return links.select(
        "wikidata_id", F.col("s.key").alias("site"), prefix.alias("prefix"),
        F.concat(prefix, F.lit("/wiki/"), title).alias("url"),
    )
