"""Which pages to read and what to review next."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from kbcurate.schemas import CITIZENSHIP, LANGUAGE_OF_WORK, OFFICIAL_LANGUAGE
from kbcurate.sources.tables import live

# Pages read per politician, days before a politician is read again, and the size
# of the review pool under which more is read.
TOP_LINKS, COOLDOWN_DAYS, MIN_POOL = 3, 365, 10


# --- page ranking ---------------------------------------------------------------------------


def edition_popularity(links: DataFrame) -> DataFrame:
    """Links per language edition over all politicians."""
    return links.groupBy("wikipedia_project_id").agg(F.count(F.lit(1)).alias("global_count"))


def citizenships(facts: DataFrame, countries: list[str] | None = None) -> DataFrame:
    """Live citizenship facts, of given countries if any."""
    rows = live(facts).where(F.col("type") == CITIZENSHIP)
    return rows.where(F.col("entity_id").isin(countries)) if countries else rows


def _relation(relations: DataFrame, kind: str) -> DataFrame:
    return live(relations).where(F.col("relation_type") == kind)


def citizenship_languages(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct (politician, language) where a citizenship country has the official language."""
    official = _relation(relations, OFFICIAL_LANGUAGE).select(
        F.col("child_entity_id").alias("entity_id"), F.col("parent_entity_id").alias("language_id")
    ).distinct()
    pairs = citizenships(facts).where(F.col("entity_id").isNotNull())
    return (
        pairs.select("politician_id", "entity_id").distinct()
        .join(official, "entity_id").select("politician_id", "language_id").distinct()
    )


def project_languages(projects: DataFrame, relations: DataFrame, languages: DataFrame) -> DataFrame:
    """(project, language) through live language-of-work edges, one row per edge."""
    return (
        _relation(relations, LANGUAGE_OF_WORK)
        .select(F.col("child_entity_id").alias("wikipedia_project_id"),
                F.col("parent_entity_id").alias("language_qid"))
        .join(projects.select(F.col("wikidata_id").alias("wikipedia_project_id")),
              "wikipedia_project_id", "left_semi")
        .join(languages.select(F.col("wikidata_id").alias("language_qid")),
              "language_qid", "left_semi")
    )


def scored_links(
    politicians: DataFrame, links: DataFrame, projects: DataFrame, relations: DataFrame,
    languages: DataFrame, facts: DataFrame, countries: list[str] | None = None,
) -> DataFrame:
    """Links with their language, citizenship match and edition popularity. A country filter
    comes before everything it can shrink, but not before the popularity counts."""
    mine = links.join(
        politicians.select(F.col("id").alias("politician_id")), "politician_id", "left_semi"
    )
    if countries:
        mine = mine.join(
            citizenships(facts, countries).select("politician_id").distinct(),
            "politician_id", "left_semi",
        )
    editions = project_languages(projects, relations, languages).join(
        edition_popularity(links), "wikipedia_project_id"
    )
    spoken = citizenship_languages(facts, relations).select(
        "politician_id", F.col("language_id").alias("language_qid"), F.lit(1).alias("_match")
    )
    return (
        mine.join(editions, "wikipedia_project_id")
        .join(spoken, ["politician_id", "language_qid"], "left")
        .select(
            "politician_id", "language_qid", "wikipedia_project_id", "url",
            F.coalesce("_match", F.lit(0)).alias("matches_citizenship"),
            F.col("global_count").alias("language_popularity"),
        )
    )


def ranked_links(*tables: DataFrame, countries: list[str] | None = None) -> DataFrame:
    """Links ranked per politician: official language of a citizenship first, then popular
    editions, then address and language. A politician has at most one link per edition (the
    table's key), which bounds the window."""
    order = Window.partitionBy("politician_id").orderBy(
        F.desc("matches_citizenship"), F.desc("language_popularity"), "url", "language_qid"
    )
    return scored_links(*tables, countries=countries).withColumn(
        "rank", F.row_number().over(order)
    )


def priority_links(ranked: DataFrame, top: int = TOP_LINKS) -> DataFrame:
    """The best links of each politician; Spark keeps only ``top`` rows per key before the
    shuffle of the ranking."""
    return ranked.where(F.col("rank") <= top).select(
        "politician_id", "rank", "url", "wikipedia_project_id"
    )


# --- enrichment queue -----------------------------------------------------------------------


def needs_enrichment(as_of: Column, days: int = COOLDOWN_DAYS) -> Column:
    cutoff = as_of - F.make_interval(days=F.lit(days))
    return F.col("enriched_at").isNull() | (F.col("enriched_at") < cutoff)


def live_politicians(politicians: DataFrame, entities: DataFrame) -> DataFrame:
    return politicians.join(live(entities).select("wikidata_id"), "wikidata_id", "left_semi")


def enrichable(
    politicians: DataFrame, links: DataFrame, entities: DataFrame, facts: DataFrame, as_of: Column,
    days: int = COOLDOWN_DAYS, languages: list[str] | None = None,
    countries: list[str] | None = None, stateless: bool = False, ranked: DataFrame | None = None,
) -> DataFrame:
    """Politicians to read pages of: linked, live, and not read within the cooldown.

    ``stateless`` keeps those without any live citizenship. ``languages`` keeps those with such a
    language among their best links; pass ``ranked`` made with the same ``countries``, which then
    only pre-filter there. ``countries`` alone keeps their citizens.
    """
    due = politicians.where(F.col("wikidata_id").isNotNull() & needs_enrichment(as_of, days))
    linked = links.select(F.col("politician_id").alias("id")).distinct()
    base = live_politicians(due, entities).join(linked, "id", "left_semi")
    if stateless:
        citizens = citizenships(facts).select(F.col("politician_id").alias("id")).distinct()
        return base.join(citizens, "id", "left_anti")
    if languages:
        top = ranked.where((F.col("rank") <= TOP_LINKS) & F.col("language_qid").isin(languages))
        return base.join(top.select(F.col("politician_id").alias("id")).distinct(), "id", "left_semi")
    if countries:
        return by_countries(base, facts, countries)
    return base


@dataclass(frozen=True)
class Schedule:
    politicians: DataFrame
    sources: DataFrame


def schedule_enrichment(queue: DataFrame, ranked: DataFrame, n: int, as_of: Column) -> Schedule:
    """The next ``n`` politicians (never read first, longest ago next, larger numbers first),
    stamped as read, and new source rows for their best links."""
    chosen = queue.orderBy(
        F.asc_nulls_first("enriched_at"), F.desc_nulls_first("wikidata_id_numeric"), "id"
    ).limit(n)
    sources = priority_links(ranked).join(
        chosen.select(F.col("id").alias("politician_id")), "politician_id", "left_semi"
    )
    return Schedule(
        chosen.withColumn("enriched_at", as_of),
        sources.select(
            F.sha2(F.concat_ws("|", F.lit("source"), "politician_id", "url"), 256).alias("id"),
            "politician_id", "url", "wikipedia_project_id", F.lit("PROCESSING").alias("status"),
        ),
    )


def source_languages(sources: DataFrame, relations: DataFrame) -> DataFrame:
    """Languages of a source's edition, through live language-of-work edges."""
    edges = _relation(relations, LANGUAGE_OF_WORK).select(
        F.col("child_entity_id").alias("wikipedia_project_id"),
        F.col("parent_entity_id").alias("language_id"),
    )
    return sources.join(edges, "wikipedia_project_id").select(
        F.col("id").alias("source_id"), "language_id"
    )


# --- review queue ---------------------------------------------------------------------------


def pending_facts(facts: DataFrame) -> DataFrame:
    """Live facts that came from a page and are not on the knowledge graph."""
    return live(facts).where(F.col("statement_id").isNull())


def with_pending(
    politicians: DataFrame, facts: DataFrame, languages: list[str] | None = None,
    references: DataFrame | None = None, source_langs: DataFrame | None = None,
) -> DataFrame:
    """Politicians with a pending fact; given languages, one with a source in one of them."""
    pending = pending_facts(facts)
    if languages:
        spoken = source_langs.where(F.col("language_id").isin(languages)).select("source_id").distinct()
        backed = references.join(spoken, "source_id", "left_semi").select(
            F.col("property_id").alias("id")
        ).distinct()
        pending = pending.join(backed, "id", "left_semi")
    return politicians.join(
        pending.select(F.col("politician_id").alias("id")).distinct(), "id", "left_semi"
    )


def by_countries(politicians: DataFrame, facts: DataFrame, countries: list[str]) -> DataFrame:
    citizens = citizenships(facts, countries).select(F.col("politician_id").alias("id")).distinct()
    return politicians.join(citizens, "id", "left_semi")


def count_pending(politicians: DataFrame) -> DataFrame:
    return politicians.agg(F.count(F.lit(1)).alias("pending"))


def has_enrichable(queue: DataFrame) -> DataFrame:
    return queue.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_enrichable"))


def stateless_buffer(politicians: DataFrame, facts: DataFrame) -> DataFrame:
    """How many politicians have a pending citizenship and none on the knowledge graph."""
    per_politician = (
        citizenships(facts).groupBy(F.col("politician_id").alias("id"))
        .agg(F.bool_or(F.col("statement_id").isNull()).alias("pending"),
             F.bool_or(F.col("statement_id").isNotNull()).alias("known"))
        .where(F.col("pending") & ~F.col("known"))
    )
    return politicians.join(per_politician, "id", "left_semi").agg(
        F.count(F.lit(1)).alias("buffered")
    )


def throttled(buffer: DataFrame, threshold: int = MIN_POOL) -> DataFrame:
    return buffer.select((F.col("buffered") >= threshold).alias("skip"))


def review_order(seed: int) -> Column:
    """A repeatable random order of politicians."""
    return F.md5(F.concat_ws("|", "wikidata_id", F.lit(str(seed))))


def next_for_review(pool: DataFrame, seed: int, exclude: list[str] | None = None) -> DataFrame:
    """One politician of the review pool at random."""
    if exclude:
        pool = pool.where(~F.col("wikidata_id").isin(exclude))
    return pool.select("id", "wikidata_id").orderBy(review_order(seed), "id").limit(1)


def pool_is_low(pool: DataFrame, queue: DataFrame, minimum: int = MIN_POOL) -> DataFrame:
    """Whether to read more pages: a small pool, and someone to read about. Either side is cut
    before it is counted."""
    sizes = pool.limit(minimum).select(F.lit(1).alias("p"), F.lit(0).alias("q")).union(
        queue.limit(1).select(F.lit(0), F.lit(1))
    )
    return sizes.agg(
        ((F.coalesce(F.sum("p"), F.lit(0)) < minimum) & (F.coalesce(F.sum("q"), F.lit(0)) > 0))
        .alias("low")
    )


# --- purge ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Purge:
    facts: DataFrame
    politicians: DataFrame
    counts: DataFrame


def unreviewed(facts: DataFrame, evaluations: DataFrame) -> DataFrame:
    judged = evaluations.select(F.col("property_id").alias("id")).distinct()
    return pending_facts(facts).join(judged, "id", "left_anti")


def purge_unreviewed(facts: DataFrame, politicians: DataFrame, evaluations: DataFrame) -> Purge:
    """Drop pending facts nobody judged and let their politicians be read again."""
    doomed = unreviewed(facts, evaluations).select("id", "politician_id")
    affected = doomed.select(F.col("politician_id").alias("id"), F.lit(True).alias("_hit")).distinct()
    per_politician = doomed.groupBy("politician_id").agg(F.count(F.lit(1)).alias("n"))
    return Purge(
        facts.join(doomed.select("id"), "id", "left_anti"),
        politicians.join(affected, "id", "left").withColumn(
            "enriched_at", F.when(F.col("_hit").isNull(), F.col("enriched_at"))
        ).drop("_hit"),
        per_politician.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("facts"),
            F.count(F.lit(1)).alias("politicians"),
        ),
    )
