"""Import rules: which dump entities become which tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from kbcurate.functions import claims as C, dates as D
from kbcurate.functions.once import once
from kbcurate.operators import entities as E
from kbcurate.schemas import (
    BIRTH_DATE, BIRTHPLACE, CITIZENSHIP, DATE_TYPES, DEATH_DATE, ENTITY_TYPES, FACT_TYPES, HUMAN,
    ISO_639_1, ISO_639_2, ISO_639_3, ISO_CODE, OCCUPATION, POLITICIAN, POSITION, PROJECT_CLASS,
    UMBRELLA_PROJECT, WEBSITE, WIKIMEDIA_CODE,
)
from kbcurate.session import shuffled, written
from kbcurate.sources.tables import upsert

def _claims() -> Column:
    return F.col("claims")


# --- hierarchy ------------------------------------------------------------------------------


@dataclass(frozen=True)
class HierarchyImport:
    entities: DataFrame
    relations: DataFrame


def import_targets(entities: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """Ids the hierarchy import touches: every parent in the dump, and every stored entity."""
    return E.parent_ids(entities).union(stored_ids.select("wikidata_id")).distinct()


def new_parents(entities: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """Parents in the dump that are not stored yet."""
    return E.parent_ids(entities).join(stored_ids.select("wikidata_id"), "wikidata_id", "left_anti")


def import_hierarchy(entities: DataFrame, stored: DataFrame, relations: DataFrame) -> HierarchyImport:
    """Entities and relations after a hierarchy import.

    Target entities found in the dump get their name and a null description (the import carries
    none); parents the dump does not describe are added with a null name. The dump is parsed once
    per output and targets are matched by id, so no pass collects ids anywhere.
    """
    targets = import_targets(entities, stored)
    found = entities.join(targets.withColumnRenamed("wikidata_id", "id"), "id", "left_semi")
    described = E.names(found).withColumn("description", F.lit(None).cast("string"))
    bare = (
        new_parents(entities, stored)
        .join(described.select("wikidata_id"), "wikidata_id", "left_anti")
        .select("wikidata_id", F.lit(None).cast("string").alias("name"),
                F.lit(None).cast("string").alias("description"))
    )
    return HierarchyImport(
        upsert(stored, described.unionByName(bare), ["wikidata_id"], ["name", "description"]),
        upsert(
            relations, E.extract_relations(found), ["statement_id"],
            ["parent_entity_id", "child_entity_id", "relation_type"],
        ),
    )


# --- typed entities -------------------------------------------------------------------------


def classify_entities(entities: DataFrame, class_sets: DataFrame) -> DataFrame:
    """(entity_id, type) of named entities whose classes meet a type's set and none of its
    ignored set.

    ``class_sets(type, class_id, ignored)``. A popular class makes a hot join key on the entity
    side only, which adaptive execution splits; the verdict is one aggregate per entity and type.
    """
    named = entities.where(F.coalesce(C.best_text(F.col("labels")), F.lit("")) != "")
    hits = E.class_rows(named).join(class_sets, "class_id")
    return (
        hits.groupBy("entity_id", "type")
        .agg(F.bool_or(~F.col("ignored")).alias("inside"), F.bool_or("ignored").alias("out"))
        .where(F.col("inside") & ~F.col("out"))
        .select("entity_id", "type")
    )


def flat_project_class(spark) -> DataFrame:
    """The class set of language editions: one fixed class, no tree."""
    return spark.sql(
        f"SELECT 'WikipediaProject' AS type, '{PROJECT_CLASS}' AS class_id, false AS ignored"
    )


def official_website() -> Column:
    """The first truthy website only, even when it has no value."""
    return C.claim_value(F.get(C.truthy(_claims(), WEBSITE), F.lit(0)))


def country_rows(entities: DataFrame) -> DataFrame:
    return entities.select(
        F.col("id").alias("wikidata_id"), C.first_value(_claims(), ISO_CODE).alias("iso_code")
    ).where(F.col("iso_code").isNotNull())


def language_rows(entities: DataFrame) -> DataFrame:
    return entities.select(
        F.col("id").alias("wikidata_id"),
        C.first_value(_claims(), ISO_639_1).alias("iso_639_1"),
        C.first_value(_claims(), ISO_639_2).alias("iso_639_2"),
        C.first_value(_claims(), ISO_639_3).alias("iso_639_3"),
        C.first_value(_claims(), WIKIMEDIA_CODE).alias("wikimedia_code"),
    )


def project_rows(entities: DataFrame) -> DataFrame:
    return (
        entities.where(~F.array_contains(C.entity_ids(_claims(), "P31"), UMBRELLA_PROJECT))
        .select(F.col("id").alias("wikidata_id"), official_website().alias("official_website"))
        .where(F.col("official_website").contains("wikipedia.org"))
    )


def plain_rows(entities: DataFrame) -> DataFrame:
    return entities.select(F.col("id").alias("wikidata_id"))


TYPE_ROWS = {
    "Country": country_rows,
    "Language": language_rows,
    "WikipediaProject": project_rows,
    "Location": plain_rows,
    "Position": plain_rows,
}


@dataclass(frozen=True)
class EntityImport:
    typed: dict[str, DataFrame]
    entities: DataFrame
    labels: DataFrame
    relations: DataFrame

    def counts(self) -> DataFrame:
        """Imported entities per type."""
        rows = None
        for name, df in self.typed.items():
            part = df.select(F.lit(name).alias("type"))
            rows = part if rows is None else rows.unionByName(part)
        return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def import_entities(entities: DataFrame, class_sets: DataFrame) -> EntityImport:
    """Supporting entities: typed tables, plus entity, label and relation rows of all of them."""
    kinds = written(classify_entities(entities, class_sets), "kinds")
    typed = {}
    accepted = None
    for name, rule in TYPE_ROWS.items():
        mine = kinds.where(F.col("type") == name).select(F.col("entity_id").alias("id"))
        typed[name] = rule(entities.join(mine, "id", "left_semi"))
        ids = typed[name].select(F.col("wikidata_id").alias("id"))
        accepted = ids if accepted is None else accepted.union(ids)
    kept = entities.join(accepted.distinct(), "id", "left_semi")
    return EntityImport(typed, E.names(kept), E.label_rows(kept), E.extract_relations(kept))


# --- politicians ----------------------------------------------------------------------------


def is_politician(entities: DataFrame, positions: DataFrame) -> DataFrame:
    """Humans whose occupation is politician or who held a known position. Only those without that
    occupation are joined, and neither side is broadcast: people and positions grow with the dump."""
    people = entities.where(F.array_contains(C.entity_ids(_claims(), "P31"), HUMAN))
    by_occupation = F.coalesce(F.array_contains(C.entity_ids(_claims(), OCCUPATION), POLITICIAN), F.lit(False))
    others = people.where(~by_occupation)
    offices = F.array_distinct(C.entity_ids(_claims(), POSITION))
    holders = (
        others.select("id", F.explode(offices).alias("wikidata_id"))
        .join(shuffled(positions.select("wikidata_id").distinct()), "wikidata_id", "left_semi")
        .select("id").distinct()
    )
    return people.where(by_occupation).union(others.join(shuffled(holders), "id", "left_semi"))


def recent_enough(entities: DataFrame, as_of: Column) -> DataFrame:
    """Keep the living and the recently dead: any death claim makes birth irrelevant; a death
    over 5 years ago rejects, and without death claims a birth over 120 years ago does."""

    def old(prop: str, years: int) -> Column:
        return F.exists(
            C.truthy(_claims(), prop),
            lambda c: once(C.claim_date(c), lambda d: F.coalesce(D.over_years_ago(d, years, as_of), F.lit(False))),
        )

    has_death = F.size(C.truthy(_claims(), DEATH_DATE)) > 0
    return entities.where(~F.when(has_death, old(DEATH_DATE, 5)).otherwise(old(BIRTH_DATE, 120)))


def politician_properties(
    politicians: DataFrame, positions: DataFrame, countries: DataFrame, locations: DataFrame
) -> DataFrame:
    """Fact rows of politicians: dates as they are; offices, citizenships and birthplaces that
    are known. When no position is known at all every position passes; no country or location
    known lets none pass."""
    claims = E.truthy_claims(politicians, FACT_TYPES)
    is_date = F.col("prop").isin(DATE_TYPES)
    known = (
        positions.select(F.lit(POSITION).alias("prop"), F.col("wikidata_id").alias("value_id"))
        .union(countries.select(F.lit(CITIZENSHIP), "wikidata_id"))
        .union(locations.select(F.lit(BIRTHPLACE), "wikidata_id"))
    )
    known = known.distinct().withColumn("_known", F.lit(True))
    open_office = (F.col("prop") == POSITION) & ~positions.limit(1).exists()
    wanted = F.when(is_date, F.col("date").isNotNull()).otherwise(
        F.col("value_id").isNotNull() & (F.col("_known").isNotNull() | open_office)
    )
    return claims.join(known, ["prop", "value_id"], "left").where(wanted).select(
        F.col("entity_id").alias("wikidata_id"), F.col("prop").alias("type"),
        F.when(is_date, F.col("date.time")).alias("value"),
        F.when(is_date, F.col("date.precision")).alias("value_precision"),
        F.when(~is_date, F.col("value_id")).alias("entity_id"),
        "statement_id", "qualifiers_json", "references_json",
    )


def politician_rows(politicians: DataFrame) -> DataFrame:
    return E.names(politicians).select(
        "wikidata_id",
        F.coalesce(F.nullif("name", F.lit("")), "wikidata_id").alias("name"),
        C.qid_number(F.col("wikidata_id")).alias("wikidata_id_numeric"),
    )


def project_prefixes(projects: DataFrame) -> DataFrame:
    """Address prefix of each language edition; of several projects with one prefix the largest
    id is used."""
    parts = F.split("official_website", "/")
    return (
        projects.where(F.col("official_website").contains("wikipedia.org") & (F.size(parts) >= 3))
        .select(F.concat(F.get(parts, F.lit(0)), F.lit("//"), F.get(parts, F.lit(2))).alias("prefix"),
                "wikidata_id")
        .groupBy("prefix")
        .agg(F.max("wikidata_id").alias("wikipedia_project_id"))
    )


def wikipedia_links(politicians: DataFrame, projects: DataFrame) -> DataFrame:
    """Page links of politicians in known language editions. An edition with a third of all
    pages is a hot key of the link side only; its prefix occurs once on the other."""
    return (
        E.sitelink_urls(politicians)
        .join(project_prefixes(projects), "prefix")
        .select("wikidata_id", "url", "wikipedia_project_id")
    )


@dataclass(frozen=True)
class PoliticianImport:
    entities: DataFrame
    labels: DataFrame
    politicians: DataFrame
    properties: DataFrame
    links: DataFrame


def politician_id(wikidata_id: Column) -> Column:
    """A politician's own id, derived from its QID so that retries give the same one."""
    return F.sha2(F.concat_ws("|", F.lit("politician"), wikidata_id), 256)


def fact_id(statement_id: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("statement"), statement_id), 256)


def import_politicians(
    entities: DataFrame,
    as_of: Column,
    positions: DataFrame,
    countries: DataFrame,
    locations: DataFrame,
    projects: DataFrame,
    stored_politicians: DataFrame,
) -> PoliticianImport:
    """Politicians of a dump with their labels, facts and page links. Stored politicians keep
    their id; new ones get a derived one, so children need no round trip to learn it."""
    chosen = written(recent_enough(is_politician(entities, positions), as_of), "politicians")
    rows = politician_rows(chosen)
    known = stored_politicians.select("wikidata_id", F.col("id").alias("_stored"))
    with_id = rows.join(shuffled(known), "wikidata_id", "left").select(
        F.coalesce("_stored", politician_id(F.col("wikidata_id"))).alias("id"),
        "wikidata_id", "wikidata_id_numeric", "name",
    )
    ids = shuffled(with_id.select("wikidata_id", F.col("id").alias("politician_id")))
    facts = (
        politician_properties(chosen, positions, countries, locations)
        .where(F.col("statement_id").isNotNull())  # the statement is a stored fact's identity
        .join(ids, "wikidata_id")
        .withColumn("id", fact_id(F.col("statement_id")))
        .drop("wikidata_id")
    )
    links = wikipedia_links(chosen, projects).join(ids, "wikidata_id").drop("wikidata_id")
    named = rows.select("wikidata_id", "name", F.lit(None).cast("string").alias("description"))
    return PoliticianImport(named, E.label_rows(chosen), with_id, facts, links)


# What makes a stored row the same, and what an import overwrites of it.
STORED_KEYS = {
    "entities": (["wikidata_id"], ["name", "description"]),
    "labels": (["entity_id", "label"], []),
    "politicians": (["wikidata_id"], ["name"]),
    "properties": (
        ["statement_id"], ["value", "value_precision", "entity_id", "qualifiers_json", "references_json"],
    ),
    "links": (["politician_id", "wikipedia_project_id"], ["url"]),
    "relations": (["statement_id"], ["parent_entity_id", "child_entity_id", "relation_type"]),
}


def store(name: str, stored: DataFrame, found: DataFrame, now: Column | None = None) -> DataFrame:
    """The stored table after the rows of an import: equal keys are overwritten in the columns an
    import owns, a soft delete stays, and stored rows with a null key are left alone."""
    keys, columns = STORED_KEYS[name]
    return upsert(stored, found, keys, [c for c in columns if c in stored.columns], now=now)


def store_typed(stored: DataFrame, found: DataFrame, now: Column | None = None) -> DataFrame:
    """A typed table after an import: one row per entity, all its columns overwritten."""
    rest = [c for c in found.columns if c in stored.columns and c != "wikidata_id"]
    return upsert(stored, found, ["wikidata_id"], rest, now=now)


def seen_ids(*outputs: DataFrame, column: str) -> DataFrame:
    """Every id that an import inserted or updated."""
    ids = outputs[0].select(column)
    for df in outputs[1:]:
        ids = ids.union(df.select(column))
    return ids.where(F.col(column).isNotNull()).distinct()


def class_table(class_sets: dict[str, tuple[DataFrame, DataFrame | None]]) -> DataFrame:
    """One (type, class_id, ignored) table of several class sets and ignored sets."""
    out = None
    for name, (inside, ignored) in class_sets.items():
        parts = [inside.select(F.lit(name).alias("type"), F.col("wikidata_id").alias("class_id"),
                               F.lit(False).alias("ignored"))]
        if ignored is not None:
            parts.append(ignored.select(F.lit(name).alias("type"),
                                        F.col("wikidata_id").alias("class_id"),
                                        F.lit(True).alias("ignored")))
        for part in parts:
            out = part if out is None else out.unionByName(part)
    return out


def class_types() -> list[str]:
    return [t for t, cfg in ENTITY_TYPES.items() if cfg.roots]
