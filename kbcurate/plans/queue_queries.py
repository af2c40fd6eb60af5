"""Queries on page ranking and the enrichment and review queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kbcurate.operators import ranking as K
from kbcurate.plans.registry import as_of, query
from kbcurate.plans.views import AS_OF, Catalog

LANGUAGES, COUNTRIES = ["L1", "L3"], ["N1", "N2", "N3", "N4", "N5", "N6"]
_LANGS = ", ".join(f"'{x}'" for x in LANGUAGES)
_COUNTRIES = ", ".join(f"'{x}'" for x in COUNTRIES)
_CITIZEN = f"""SELECT politician_id FROM v_properties
    WHERE type = 'P27' AND deleted_at IS NULL AND entity_id IN ({_COUNTRIES})"""


@query("SELECT wikipedia_project_id, count(*) AS global_count FROM v_links GROUP BY wikipedia_project_id")
def edition_popularity(c: Catalog) -> DataFrame:
    return K.edition_popularity(c.v_links)


_SPOKEN = """SELECT DISTINCT p.politician_id, e.parent_entity_id AS language_id FROM v_properties p
    JOIN v_edges e ON p.entity_id = e.child_entity_id AND e.relation_type = 'P37' AND e.deleted_at IS NULL
    WHERE p.type = 'P27' AND p.deleted_at IS NULL"""


@query(_SPOKEN)
def citizenship_languages(c: Catalog) -> DataFrame:
    return K.citizenship_languages(c.v_properties, c.v_edges)


def _ranked_sql(where: str = "") -> str:
    return f"""
    SELECT l.politician_id, e.parent_entity_id AS language_qid, l.wikipedia_project_id, l.url,
           CASE WHEN s.politician_id IS NULL THEN 0 ELSE 1 END AS matches_citizenship,
           g.global_count AS language_popularity,
           row_number() OVER (PARTITION BY l.politician_id ORDER BY CASE WHEN s.politician_id IS NULL THEN 0 ELSE 1 END DESC,
               g.global_count DESC, l.url, e.parent_entity_id) AS rank
    FROM v_politicians p JOIN v_links l ON l.politician_id = p.id
    JOIN v_projects w ON w.wikidata_id = l.wikipedia_project_id
    JOIN v_edges e ON e.child_entity_id = w.wikidata_id AND e.relation_type = 'P407' AND e.deleted_at IS NULL
    JOIN v_languages v ON v.wikidata_id = e.parent_entity_id
    JOIN (SELECT wikipedia_project_id, count(*) AS global_count FROM v_links GROUP BY 1) g
        ON g.wikipedia_project_id = l.wikipedia_project_id
    LEFT JOIN ({_SPOKEN}) s ON s.politician_id = p.id AND s.language_id = v.wikidata_id {where}"""


_RANKED = _ranked_sql()


def ranked(c: Catalog, countries: list[str] | None = None) -> DataFrame:
    return K.ranked_links(
        c.v_politicians, c.v_links, c.v_projects, c.v_edges, c.v_languages, c.v_properties,
        countries=countries,
    )


@query(_RANKED)
def ranked_links(c: Catalog) -> DataFrame:
    return ranked(c).withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT politician_id, rank, url, wikipedia_project_id FROM ({_RANKED}) r WHERE rank <= 3")
def priority_links(c: Catalog) -> DataFrame:
    return K.priority_links(ranked(c)).withColumn("rank", F.col("rank").cast("long"))


_ENRICHABLE = f"""SELECT p.id, p.enriched_at, p.wikidata_id_numeric FROM v_politicians p
    JOIN v_entities e ON e.wikidata_id = p.wikidata_id AND e.deleted_at IS NULL
    WHERE p.id IN (SELECT politician_id FROM v_links)
      AND (p.enriched_at IS NULL OR p.enriched_at < {AS_OF} - INTERVAL '1' DAY * 365)"""


def _queue(c: Catalog, **kw) -> DataFrame:
    return K.enrichable(c.v_politicians, c.v_links, c.v_entities, c.v_properties, as_of(), **kw)


@query(f"SELECT id FROM ({_ENRICHABLE}) x")
def enrichable(c: Catalog) -> DataFrame:
    return _queue(c).select("id")


@query(f"""SELECT id FROM ({_ENRICHABLE}) x
    WHERE id NOT IN (SELECT politician_id FROM v_properties WHERE type = 'P27' AND deleted_at IS NULL)""")
def enrichable_stateless(c: Catalog) -> DataFrame:
    return _queue(c, stateless=True).select("id")


@query(f"""SELECT id FROM ({_ENRICHABLE}) x WHERE id IN (
    SELECT politician_id FROM ({_ranked_sql(f"WHERE l.politician_id IN ({_CITIZEN})")}) r
    WHERE rank <= 3 AND language_qid IN ({_LANGS}))""")
def enrichable_by_language(c: Catalog) -> DataFrame:
    return _queue(c, languages=LANGUAGES, countries=COUNTRIES, ranked=ranked(c, COUNTRIES)).select("id")


@query(f"SELECT id FROM ({_ENRICHABLE}) x WHERE id IN ({_CITIZEN})")
def enrichable_by_country(c: Catalog) -> DataFrame:
    return _queue(c, countries=COUNTRIES).select("id")


@query(f"""
    WITH chosen AS (SELECT id FROM ({_ENRICHABLE}) x
        ORDER BY enriched_at ASC NULLS FIRST, wikidata_id_numeric DESC NULLS FIRST, id LIMIT 25)
    SELECT 'politician' AS kind, id, '' AS url FROM chosen
    UNION ALL SELECT 'source', politician_id, url FROM ({_RANKED}) r
    WHERE rank <= 3 AND politician_id IN (SELECT id FROM chosen)""")
def schedule_enrichment(c: Catalog) -> DataFrame:
    plan = K.schedule_enrichment(_queue(c), ranked(c), 25, as_of())
    return plan.politicians.select(F.lit("politician").alias("kind"), "id", F.lit("").alias("url")).unionByName(
        plan.sources.select(F.lit("source").alias("kind"), F.col("politician_id").alias("id"), "url")
    )


@query("""
    SELECT s.id AS source_id, e.parent_entity_id AS language_id FROM v_sources s
    JOIN v_edges e ON e.child_entity_id = s.wikipedia_project_id AND e.relation_type = 'P407' AND e.deleted_at IS NULL""")
def source_languages(c: Catalog) -> DataFrame:
    return K.source_languages(c.v_sources, c.v_edges)


_LIVE = """SELECT p.id, p.wikidata_id FROM v_politicians p
    JOIN v_entities e ON e.wikidata_id = p.wikidata_id AND e.deleted_at IS NULL"""
_PENDING = f"""SELECT id, wikidata_id FROM ({_LIVE}) x
    WHERE id IN (SELECT politician_id FROM v_properties WHERE statement_id IS NULL AND deleted_at IS NULL)"""
_PENDING_LANG = f"""SELECT id, wikidata_id FROM ({_LIVE}) x WHERE id IN (
    SELECT f.politician_id FROM v_properties f JOIN v_references r ON r.property_id = f.id
    JOIN v_source_languages s ON s.source_id = r.source_id
    WHERE f.statement_id IS NULL AND f.deleted_at IS NULL AND s.language_id IN ({_LANGS}))"""


@query(f"SELECT id FROM ({_LIVE}) x")
def live_politicians(c: Catalog) -> DataFrame:
    return K.live_politicians(c.v_politicians, c.v_entities).select("id")


def _pool(c: Catalog, languages: list[str] | None = None) -> DataFrame:
    return K.with_pending(
        K.live_politicians(c.v_politicians, c.v_entities), c.v_properties, languages,
        c.v_references, c.v_source_languages,
    )


@query(f"SELECT id FROM ({_PENDING}) x")
def with_pending(c: Catalog) -> DataFrame:
    return _pool(c).select("id")


@query(f"SELECT id FROM ({_PENDING_LANG}) x")
def with_pending_languages(c: Catalog) -> DataFrame:
    return _pool(c, LANGUAGES).select("id")


@query(f"SELECT id FROM ({_LIVE}) x WHERE id IN ({_CITIZEN})")
def by_countries(c: Catalog) -> DataFrame:
    return K.by_countries(
        K.live_politicians(c.v_politicians, c.v_entities), c.v_properties, COUNTRIES
    ).select("id")


@query(f"SELECT count(*) AS pending FROM ({_PENDING_LANG}) x WHERE id IN ({_CITIZEN})")
def count_pending(c: Catalog) -> DataFrame:
    return K.count_pending(K.by_countries(_pool(c, LANGUAGES), c.v_properties, COUNTRIES))


@query(f"SELECT count(*) > 0 AS has_enrichable FROM ({_ENRICHABLE}) x")
def has_enrichable(c: Catalog) -> DataFrame:
    return K.has_enrichable(_queue(c))


_BUFFER = """SELECT count(*) AS buffered FROM v_politicians
    WHERE id IN (SELECT politician_id FROM v_properties WHERE type = 'P27' AND statement_id IS NULL AND deleted_at IS NULL)
      AND id NOT IN (SELECT politician_id FROM v_properties WHERE type = 'P27' AND statement_id IS NOT NULL AND deleted_at IS NULL)"""


@query(_BUFFER)
def stateless_buffer(c: Catalog) -> DataFrame:
    return K.stateless_buffer(c.v_politicians, c.v_properties)


@query(f"SELECT buffered >= 10 AS skip FROM ({_BUFFER}) b")
def throttled(c: Catalog) -> DataFrame:
    return K.throttled(K.stateless_buffer(c.v_politicians, c.v_properties))


@query(f"""SELECT id, wikidata_id FROM ({_PENDING_LANG}) x WHERE wikidata_id NOT IN ('C4', 'C8')
    ORDER BY md5(wikidata_id || '|7'), id LIMIT 1""")
def next_for_review(c: Catalog) -> DataFrame:
    return K.next_for_review(_pool(c, LANGUAGES), seed=7, exclude=["C4", "C8"])


@query(f"SELECT (SELECT count(*) FROM ({_PENDING}) x) < 10 AND (SELECT count(*) FROM ({_ENRICHABLE}) y) > 0 AS low")
def pool_is_low(c: Catalog) -> DataFrame:
    return K.pool_is_low(_pool(c), _queue(c))


_DOOMED = """SELECT id, politician_id FROM v_properties WHERE statement_id IS NULL AND deleted_at IS NULL
    AND id NOT IN (SELECT property_id FROM v_evaluations)"""


@query(f"""
    WITH doomed AS ({_DOOMED})
    SELECT 'fact left' AS kind, id, CAST(NULL AS STRING) AS value FROM v_properties WHERE id NOT IN (SELECT id FROM doomed)
    UNION ALL SELECT 'politician', id,
        CASE WHEN id NOT IN (SELECT politician_id FROM doomed) THEN CAST(enriched_at AS STRING) END FROM v_politicians
    UNION ALL SELECT 'count', 'facts', CAST(count(*) AS STRING) FROM doomed
    UNION ALL SELECT 'count', 'politicians', CAST(count(DISTINCT politician_id) AS STRING) FROM doomed""")
def purge_unreviewed(c: Catalog) -> DataFrame:
    """The facts left, all politicians with when they were read, and the two counts."""
    out = K.purge_unreviewed(c.v_properties, c.v_politicians, c.v_evaluations)
    none = F.lit(None).cast("string")
    counts = out.counts.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("id"), F.col(n).cast("string").alias("value")) for n in ("facts", "politicians")
    ])))
    return out.facts.select(F.lit("fact left").alias("kind"), "id", none.alias("value")).union(
        out.politicians.select(F.lit("politician"), "id", F.col("enriched_at").cast("string"))
    ).union(counts.select(F.lit("count"), "id", "value"))
