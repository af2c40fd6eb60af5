"""Queries over the dump: parsing, entity projections, import rules, class closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kbcurate.functions import claims as C
from kbcurate.operators import entities as E, hierarchy as H, importer as I, search as S
from kbcurate.plans.dump_lines import dump_lines
from kbcurate.plans.registry import as_of, query
from kbcurate.plans.views import AS_OF, Catalog
from kbcurate.schemas import FACT_TYPES, RELATION_TYPES, EntityType
from kbcurate.session import scratch_path, written
from kbcurate.sources import tables as T
from kbcurate.sources.dump import entity_table, parse_entities, read_dump
from kbcurate.sources.tables import upsert

ROOTS, IGNORED = ["P1"], ["P5"]
_RELATIONS = ", ".join(f"'{r}'" for r in RELATION_TYPES)
_FACTS = ", ".join(f"'{r}'" for r in FACT_TYPES)


def entities(c: Catalog) -> DataFrame:
    return c.shared("entities", lambda _: entity_table(dump_lines(c)))


@query("""
    SELECT e.wikidata_id AS id, coalesce(l.n, 0) AS labels, coalesce(s.n, 0) AS sitelinks,
           coalesce(k.n, 0) AS p279
    FROM v_entities e
    LEFT JOIN (SELECT entity_id, count(*) AS n FROM v_texts WHERE field = 'labels' GROUP BY entity_id) l
        ON l.entity_id = e.wikidata_id
    LEFT JOIN (SELECT entity_id, count(*) AS n FROM v_sitelinks GROUP BY entity_id) s ON s.entity_id = e.wikidata_id
    LEFT JOIN (SELECT entity_id, count(*) AS n FROM v_claims WHERE prop = 'P279' GROUP BY entity_id) k
        ON k.entity_id = e.wikidata_id""")
def parse_entities_query(c: Catalog) -> DataFrame:
    def size(col):
        return F.coalesce(F.when(F.size(col) >= 0, F.size(col)), F.lit(0)).cast("long")

    return parse_entities(dump_lines(c)).select(
        "id", size(F.map_keys("labels")).alias("labels"), size(F.map_keys("sitelinks")).alias("sitelinks"),
        size(F.col("claims.P279")).alias("p279"),
    )


_BEST = """(
    SELECT entity_id, coalesce(max(CASE WHEN lang = 'mul' THEN text END),
                               max(CASE WHEN lang = 'en' THEN text END),
                               max(CASE WHEN ord = 0 THEN text END)) AS name
    FROM v_texts WHERE field = 'labels' GROUP BY entity_id)"""


NAMES_SQL = f"""
    SELECT e.wikidata_id, n.name, e.description FROM v_entities e
    LEFT JOIN {_BEST} n ON n.entity_id = e.wikidata_id"""


@query(NAMES_SQL)
def best_text(c: Catalog) -> DataFrame:
    return E.names(entities(c))


@query("SELECT DISTINCT entity_id, text AS label FROM v_texts WHERE field = 'labels'")
def all_labels(c: Catalog) -> DataFrame:
    return E.label_rows(entities(c))


@query("""
    SELECT wikidata_id, max(CASE WHEN lang = 'fr' THEN text END) AS fr,
           CASE WHEN wikidata_id LIKE 'C%' THEN NULL ELSE -1 END AS number
    FROM v_entities LEFT JOIN v_texts ON entity_id = wikidata_id AND field = 'labels'
    GROUP BY wikidata_id""")
def label_of_language(c: Catalog) -> DataFrame:
    """Label of one language; ids that do not start with Q have no number."""
    return entities(c).select(
        F.col("id").alias("wikidata_id"), C.label(F.col("labels"), "fr").alias("fr"),
        F.when(~F.col("id").startswith("C"), F.coalesce(C.qid_number(F.col("id")), F.lit(-1)))
        .alias("number"),
    )


@query("SELECT o_orderkey AS k, o_orderkey AS number FROM orders WHERE o_orderkey % 2 = 0")
def qid_number(c: Catalog) -> DataFrame:
    k = F.col("o_orderkey")
    qid = F.concat(F.when(k % 2 == 0, "Q").otherwise("L"), k.cast("string"))
    return c.table("orders").select(k.alias("k"), C.qid_number(qid).cast("long").alias("number")).where(
        F.col("number").isNotNull()
    )


@query(f"""
    SELECT entity_id, prop, coalesce(rank, 'normal') AS rank, statement_id, value_id, time,
           CAST(precision AS STRING) AS precision
    FROM v_truthy WHERE prop IN ({_RELATIONS}, {_FACTS})""")
def truthy_claims(c: Catalog) -> DataFrame:
    rows = E.truthy_claims(entities(c), RELATION_TYPES + FACT_TYPES)
    return rows.select(
        "entity_id", "prop", "rank", "statement_id", "value_id", F.col("date.time").alias("time"),
        F.col("date.precision").cast("string").alias("precision"),
    )


@query("""
    SELECT DISTINCT entity_id, value_id AS class_id FROM v_truthy
    WHERE prop IN ('P31', 'P279') AND value_id IS NOT NULL""")
def class_ids(c: Catalog) -> DataFrame:
    return E.class_rows(entities(c))


RELATIONS_SQL = f"""
    SELECT value_id AS parent_entity_id, entity_id AS child_entity_id, prop AS relation_type, statement_id
    FROM v_truthy WHERE prop IN ({_RELATIONS}) AND value_id IS NOT NULL AND statement_id IS NOT NULL"""


@query(RELATIONS_SQL)
def extract_relations(c: Catalog) -> DataFrame:
    return E.extract_relations(entities(c))


@query(f"""
    SELECT DISTINCT value_id AS wikidata_id FROM v_truthy
    WHERE prop IN ({_RELATIONS}) AND value_id IS NOT NULL""")
def parent_ids(c: Catalog) -> DataFrame:
    return E.parent_ids(entities(c))


_SITES = """
    SELECT entity_id AS wikidata_id, site, 'https://' || replace(site, 'wiki', '') || '.wikipedia.org' AS prefix,
           'https://' || replace(site, 'wiki', '') || '.wikipedia.org/wiki/' || replace(title, ' ', '_') AS url
    FROM v_sitelinks WHERE site LIKE '%wiki' AND site NOT IN ('commonswiki', 'simplewiki')"""


@query(_SITES)
def sitelink_urls(c: Catalog) -> DataFrame:
    return E.sitelink_urls(entities(c))


# --- closures -------------------------------------------------------------------------------


def closure_sql(name: str, roots: list[str]) -> str:
    listed = ", ".join(f"'{r}'" for r in roots)
    return f"""{name} AS (
        SELECT wikidata_id FROM v_entities WHERE wikidata_id IN ({listed})
        UNION
        SELECT child_entity_id FROM v_edges JOIN {name} ON parent_entity_id = wikidata_id
        WHERE relation_type = 'P279')"""


_TREES = f"WITH RECURSIVE {closure_sql('down', ROOTS)}, {closure_sql('ignored', IGNORED)}"


@query(f"WITH RECURSIVE {closure_sql('down', ROOTS)} SELECT wikidata_id FROM down")
def descendants(c: Catalog) -> DataFrame:
    return H.descendants(c.v_entities, c.v_edges, ROOTS)


@query(f"{_TREES} SELECT wikidata_id FROM down EXCEPT SELECT wikidata_id FROM ignored")
def class_set(c: Catalog) -> DataFrame:
    return H.class_set(c.v_entities, c.v_edges, ROOTS, IGNORED)


@query(f"WITH RECURSIVE {closure_sql('ignored', IGNORED)} SELECT wikidata_id FROM ignored")
def ignored_set(c: Catalog) -> DataFrame:
    return H.ignored_set(c.v_entities, c.v_edges, IGNORED)


def _outside(c: Catalog) -> DataFrame:
    inside = H.descendants(c.v_entities, c.v_edges, ROOTS)
    ignored = H.descendants(c.v_entities, c.v_edges, IGNORED)
    return H.outside_hierarchy(c.v_positions, c.v_edges, inside, ignored)


_OUTSIDE = f"""{_TREES}, outside AS (
    SELECT p.wikidata_id FROM v_positions p
    WHERE NOT EXISTS (SELECT 1 FROM v_edges e JOIN down ON e.parent_entity_id = down.wikidata_id
                      WHERE e.child_entity_id = p.wikidata_id AND e.relation_type IN ('P31', 'P279'))
       OR EXISTS (SELECT 1 FROM v_edges e JOIN ignored ON e.parent_entity_id = ignored.wikidata_id
                  WHERE e.child_entity_id = p.wikidata_id AND e.relation_type IN ('P31', 'P279')))"""


@query(f"{_OUTSIDE} SELECT wikidata_id FROM outside")
def outside_hierarchy(c: Catalog) -> DataFrame:
    return _outside(c)


@query(f"""{_OUTSIDE}, hit AS (
        SELECT p.id, p.statement_id, v.property_id FROM v_properties p
        LEFT JOIN v_evaluations v ON v.property_id = p.id
        WHERE p.type = 'P39' AND p.deleted_at IS NULL AND p.entity_id IN (SELECT wikidata_id FROM outside))
    SELECT (SELECT count(*) FROM outside) AS entities_removed, (SELECT count(*) FROM v_positions) AS total_entities,
           (SELECT count(*) FROM hit) AS properties_deleted,
           (SELECT count(*) FROM v_properties WHERE type = 'P39' AND deleted_at IS NULL) AS properties_total,
           (SELECT count(*) FROM hit WHERE statement_id IS NULL) AS properties_extracted,
           (SELECT count(DISTINCT property_id) FROM hit WHERE statement_id IS NULL) AS properties_evaluated,
           round((SELECT count(*) FROM outside) * 100.0 / (SELECT count(*) FROM v_positions), 4) AS removed_percent""")
def preview_outside(c: Catalog) -> DataFrame:
    preview = H.preview_outside(c.v_positions, _outside(c), c.v_properties, c.v_evaluations, "P39")
    return H.with_percentages(preview).drop("deleted_percent").withColumn(
        "removed_percent", F.round("removed_percent", 4)
    )


@query(f"""{_OUTSIDE}
    SELECT 'fact' AS kind, id FROM v_properties
    WHERE type = 'P39' AND deleted_at IS NULL AND entity_id IN (SELECT wikidata_id FROM outside)
    UNION ALL SELECT 'kept', wikidata_id FROM v_positions WHERE wikidata_id NOT IN (SELECT wikidata_id FROM outside)
    UNION ALL SELECT 'unindexed', wikidata_id FROM outside""")
def cleanup_outside(c: Catalog) -> DataFrame:
    done = H.cleanup_outside(c.v_positions, _outside(c), c.v_properties, "P39", F.expr("TIMESTAMP '2024-02-01 00:00:00'"))
    gone = done.facts.where("deleted_at = TIMESTAMP '2024-02-01 00:00:00'")
    return (
        gone.select(F.lit("fact").alias("kind"), "id")
        .unionByName(done.kept.select(F.lit("kept").alias("kind"), F.col("wikidata_id").alias("id")))
        .unionByName(done.index_deletes.select(F.lit("unindexed").alias("kind"), F.col("wikidata_id").alias("id")))
    )


@query("""
    SELECT wikidata_id FROM v_entities WHERE wikidata_id NOT IN (
        SELECT wikidata_id FROM v_typed UNION SELECT wikidata_id FROM v_languages UNION SELECT wikidata_id FROM v_projects
        UNION SELECT language_id FROM v_source_languages
        UNION SELECT entity_id FROM v_properties WHERE entity_id IS NOT NULL
        UNION SELECT parent_entity_id FROM v_edges WHERE child_entity_id IN (
            SELECT wikidata_id FROM v_typed UNION SELECT wikidata_id FROM v_languages UNION SELECT wikidata_id FROM v_projects))""")
def orphans(c: Catalog) -> DataFrame:
    return H.orphans(
        c.v_entities, [c.v_typed, c.v_languages, c.v_projects], c.v_source_languages,
        c.v_properties, c.v_edges,
    )


# --- import rules ---------------------------------------------------------------------------


def _class_sets(c: Catalog) -> DataFrame:
    positions = (
        H.class_set(c.v_entities, c.v_edges, ROOTS, IGNORED),
        H.ignored_set(c.v_entities, c.v_edges, IGNORED),
    )
    return I.class_table({"Position": positions, "Location": (c.v_countries, None)}).unionByName(
        I.flat_project_class(c.spark)
    )


_KINDS = f"""{_TREES}, named AS (SELECT entity_id FROM {_BEST} n WHERE coalesce(name, '') <> ''),
    classes AS (SELECT DISTINCT entity_id, value_id FROM v_truthy
                WHERE prop IN ('P31', 'P279') AND value_id IS NOT NULL AND entity_id IN (SELECT entity_id FROM named)),
    kinds AS (
        SELECT DISTINCT entity_id, 'Position' AS type FROM classes
        WHERE value_id IN (SELECT wikidata_id FROM down EXCEPT SELECT wikidata_id FROM ignored)
          AND entity_id NOT IN (SELECT entity_id FROM classes WHERE value_id IN (SELECT wikidata_id FROM ignored))
        UNION SELECT entity_id, 'Location' FROM classes WHERE value_id IN (SELECT wikidata_id FROM v_countries)
        UNION SELECT entity_id, 'WikipediaProject' FROM classes WHERE value_id = 'Q10876391')"""


@query(f"{_KINDS} SELECT entity_id, type FROM kinds")
def classify_entities(c: Catalog) -> DataFrame:
    return I.classify_entities(entities(c), _class_sets(c))


_PROJECTS = """
    SELECT entity_id FROM v_truthy WHERE prop = 'P856' AND ord = 0 AND text LIKE '%wikipedia.org%'
    AND entity_id NOT IN (SELECT entity_id FROM v_truthy WHERE prop = 'P31' AND value_id = 'Q210588')"""


@query(f"""{_KINDS}
    SELECT type, count(*) AS n FROM kinds
    WHERE type <> 'WikipediaProject' OR entity_id IN ({_PROJECTS}) GROUP BY type""")
def import_entities(c: Catalog) -> DataFrame:
    return I.import_entities(entities(c), _class_sets(c)).counts()


@query("""
    SELECT entity_id AS wikidata_id, min_by(text, ord) AS iso_code FROM v_truthy
    WHERE prop = 'P297' AND text IS NOT NULL GROUP BY entity_id""")
def country_rows(c: Catalog) -> DataFrame:
    return I.country_rows(entities(c))


@query("SELECT wikidata_id, iso_639_1, iso_639_3 FROM v_languages")
def language_rows(c: Catalog) -> DataFrame:
    return I.language_rows(entities(c)).where(F.col("iso_639_1").isNotNull()).select(
        "wikidata_id", "iso_639_1", "iso_639_3"
    )


@query(f"SELECT wikidata_id, official_website FROM v_projects WHERE wikidata_id IN ({_PROJECTS})")
def project_rows(c: Catalog) -> DataFrame:
    return I.project_rows(entities(c))


_IS_POLITICIAN = """
    SELECT entity_id FROM v_truthy WHERE prop = 'P31' AND value_id = 'Q5' AND entity_id IN (
        SELECT entity_id FROM v_truthy WHERE (prop = 'P106' AND value_id = 'Q82955')
           OR (prop = 'P39' AND value_id IN (SELECT wikidata_id FROM v_positions)))"""

# as_of 2024-01-31: over n years ago, at the precision of the date
_OLD = """(precision = 9 AND y < 2024 - {n}) OR (precision = 10 AND y * 100 + m < (2024 - {n}) * 100 + 1)
       OR (precision = 11 AND y * 10000 + m * 100 + d < (2024 - {n}) * 10000 + 131)"""

_RECENT = f"""
    SELECT wikidata_id FROM v_entities WHERE CASE
        WHEN wikidata_id IN (SELECT entity_id FROM v_truthy WHERE prop = 'P570')
        THEN wikidata_id NOT IN (SELECT entity_id FROM v_truthy WHERE prop = 'P570' AND ({_OLD.format(n=5)}))
        ELSE wikidata_id NOT IN (SELECT entity_id FROM v_truthy WHERE prop = 'P569' AND ({_OLD.format(n=120)})) END"""


@query(_IS_POLITICIAN)
def is_politician(c: Catalog) -> DataFrame:
    return I.is_politician(entities(c), c.v_positions).select(F.col("id").alias("entity_id"))


@query(_RECENT)
def recent_enough(c: Catalog) -> DataFrame:
    return I.recent_enough(entities(c), as_of()).select(F.col("id").alias("wikidata_id"))


_CHOSEN = f"SELECT wikidata_id FROM ({_RECENT}) r WHERE wikidata_id IN ({_IS_POLITICIAN})"
_FACT_ROWS = f"""
    SELECT entity_id AS wikidata_id, prop AS type, time AS value, CAST(precision AS STRING) AS value_precision,
           CASE WHEN prop IN ('P569', 'P570') THEN NULL ELSE value_id END AS entity_id, statement_id
    FROM v_truthy WHERE entity_id IN ({_CHOSEN}) AND (
        (prop IN ('P569', 'P570') AND time IS NOT NULL)
        OR (prop = 'P39' AND value_id IN (SELECT wikidata_id FROM v_positions))
        OR (prop = 'P27' AND value_id IN (SELECT wikidata_id FROM v_countries))
        OR (prop = 'P19' AND value_id IN (SELECT wikidata_id FROM v_locations)))"""


def _chosen(c: Catalog) -> DataFrame:
    return I.recent_enough(I.is_politician(entities(c), c.v_positions), as_of())


@query(_FACT_ROWS)
def politician_properties(c: Catalog) -> DataFrame:
    rows = I.politician_properties(_chosen(c), c.v_positions, c.v_countries, c.v_locations)
    return rows.select(
        "wikidata_id", "type", "value", F.col("value_precision").cast("string").alias("value_precision"),
        "entity_id", "statement_id",
    )


@query(f"""
    SELECT e.wikidata_id, coalesce(n.name, e.wikidata_id) AS name FROM v_entities e
    LEFT JOIN {_BEST} n ON n.entity_id = e.wikidata_id WHERE e.wikidata_id IN ({_CHOSEN})""")
def politician_rows(c: Catalog) -> DataFrame:
    return I.politician_rows(_chosen(c)).drop("wikidata_id_numeric")


@query(f"""
    SELECT s.wikidata_id, s.url, p.wikidata_id AS wikipedia_project_id FROM ({_SITES}) s
    JOIN v_projects p ON s.prefix || '/' = p.official_website WHERE s.wikidata_id IN ({_CHOSEN})""")
def wikipedia_links(c: Catalog) -> DataFrame:
    return I.wikipedia_links(_chosen(c), c.v_projects)


@query(f"""
    SELECT 'politician' AS output, count(*) AS n FROM ({_CHOSEN}) x
    UNION ALL SELECT 'fact', count(*) FROM ({_FACT_ROWS}) x
    UNION ALL SELECT 'label', count(*) FROM (SELECT DISTINCT entity_id, text FROM v_texts
        WHERE field = 'labels' AND entity_id IN ({_CHOSEN})) x
    UNION ALL SELECT 'kept id', count(*) FROM v_politicians WHERE wikidata_id IN ({_CHOSEN})""")
def import_politicians(c: Catalog) -> DataFrame:
    out = I.import_politicians(
        entities(c), as_of(), c.v_positions, c.v_countries, c.v_locations, c.v_projects, c.v_politicians
    )
    kept = out.politicians.where(F.col("id").startswith("pol-"))

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("output"), "n")

    return (
        count(out.politicians, "politician").union(count(out.properties, "fact"))
        .union(count(out.labels, "label")).union(count(kept, "kept id"))
    )


_STORED = "SELECT wikidata_id, 'old ' || name AS name, description FROM v_entities WHERE k % 2 = 0"


@query(f"""
    WITH targets AS (
        SELECT value_id AS wikidata_id FROM v_truthy WHERE prop IN ({_RELATIONS}) AND value_id IS NOT NULL
        UNION SELECT wikidata_id FROM ({_STORED}) s)
    SELECT t.wikidata_id, n.name, CAST(NULL AS STRING) AS description FROM targets t
    LEFT JOIN {_BEST} n ON n.entity_id = t.wikidata_id""")
def import_hierarchy(c: Catalog) -> DataFrame:
    relations = c.v_edges.select("parent_entity_id", "child_entity_id", "relation_type", "statement_id")
    return I.import_hierarchy(entities(c), c.sql(_STORED), relations).entities


@query(f"""
    SELECT statement_id, parent_entity_id FROM v_edges WHERE statement_id NOT IN (
        SELECT statement_id FROM v_truthy WHERE prop IN ({_RELATIONS}) AND value_id IS NOT NULL
        AND statement_id IS NOT NULL)
    UNION ALL
    SELECT statement_id, value_id FROM v_truthy WHERE prop IN ({_RELATIONS}) AND value_id IS NOT NULL
    AND statement_id IS NOT NULL""")
def import_relations(c: Catalog) -> DataFrame:
    """Stored relations after all dump entities were imported over them."""
    relations = c.v_edges.select("parent_entity_id", "child_entity_id", "relation_type", "statement_id")
    imported = I.import_hierarchy(entities(c), c.v_entities.select("wikidata_id", "name", "description"), relations)
    return imported.relations.select("statement_id", "parent_entity_id")


@query(f"""
    SELECT entity_id AS id, 'entity' AS kind FROM (SELECT wikidata_id AS entity_id FROM v_entities) e
    UNION ALL
    SELECT DISTINCT statement_id, 'statement' FROM v_truthy
    WHERE prop IN ({_RELATIONS}) AND value_id IS NOT NULL AND statement_id IS NOT NULL""")
def seen_ids(c: Catalog) -> DataFrame:
    ents = entities(c)
    seen_entities = I.seen_ids(E.names(ents), column="wikidata_id")
    statements = I.seen_ids(E.extract_relations(ents), column="statement_id")
    return seen_entities.select(F.col("wikidata_id").alias("id"), F.lit("entity").alias("kind")).union(
        statements.select("statement_id", F.lit("statement"))
    )


@query("""
    SELECT id, name, batch FROM (
        SELECT 'S' || CAST(s_suppkey AS STRING) AS id, s_name AS name, 'stored' AS batch FROM supplier
        WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)
        UNION ALL
        SELECT 'S' || CAST(l_suppkey AS STRING), max_by('order ' || CAST(l_orderkey AS STRING),
               l_orderkey * 10 + l_linenumber), 'updated'
        FROM lineitem GROUP BY l_suppkey
        UNION ALL
        SELECT 'X' || CAST(l_partkey AS STRING), max_by('order ' || CAST(l_orderkey AS STRING),
               l_orderkey * 10 + l_linenumber), 'inserted'
        FROM lineitem GROUP BY l_partkey) u""")
def upsert_query(c: Catalog) -> DataFrame:
    """Line items as a batch over stored suppliers: repeated keys, the last line wins."""
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    name = F.concat(F.lit("order "), F.col("l_orderkey").cast("string"))
    items = c.table("lineitem")
    batch = items.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("id"), name.alias("name"), line.alias("line")
    ).union(items.select(F.concat(F.lit("X"), F.col("l_partkey").cast("string")), name, line))
    stored = c.table("supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"),
        F.lit(None).cast("long").alias("line"),
    )
    merged = upsert(stored, batch, ["id"], ["name", "line"], order=["line"])
    kind = (
        F.when(F.col("line").isNull(), "stored").when(F.col("id").startswith("S"), "updated")
        .otherwise("inserted")
    )
    return merged.select("id", "name", kind.alias("batch"))


# --- files ----------------------------------------------------------------------------------

_NAMES = f"""SELECT e.wikidata_id, n.name FROM v_entities e LEFT JOIN {_BEST} n ON n.entity_id = e.wikidata_id"""


def _dump_file(c: Catalog, compression: str) -> str:
    """The made dump as files, with some broken lines."""
    path = scratch_path(c.spark, "dump-file")
    lines = dump_lines(c)
    broken = lines.where(F.col("value").contains('"id":"P1')).select(
        F.substring("value", 1, 20).alias("value")
    )
    lines.select("value").union(broken).write.option("compression", compression).text(path)
    return path


def _names_of_file(c: Catalog, compression: str) -> DataFrame:
    return E.names(entity_table(read_dump(c.spark, _dump_file(c, compression)))).select("wikidata_id", "name")


@query(_NAMES)
def read_dump_text(c: Catalog) -> DataFrame:
    return _names_of_file(c, "none")


@query(_NAMES)
def read_dump_bz2(c: Catalog) -> DataFrame:
    return _names_of_file(c, "bzip2")


@query("""SELECT t.wikidata_id, e.name FROM (SELECT DISTINCT wikidata_id FROM v_typed) t
    JOIN v_entities e ON e.wikidata_id = t.wikidata_id""")
def export_named(c: Catalog) -> DataFrame:
    """A typed table exported as CSV and read back."""
    path = scratch_path(c.spark, "export")
    T.export_named(T.named(c.v_typed.select("wikidata_id").distinct(), c.v_entities), path)
    return c.spark.read.option("header", True).csv(path)


@query("""
    SELECT t.wikidata_id, string_agg(DISTINCT t.type, ',' ORDER BY t.type) AS types,
           string_agg(DISTINCT l.label, ',' ORDER BY l.label) AS labels
    FROM v_typed t JOIN v_labels l ON l.entity_id = t.wikidata_id
    JOIN v_entities e ON e.wikidata_id = t.wikidata_id AND e.deleted_at IS NULL GROUP BY 1""")
def write_documents(c: Catalog) -> DataFrame:
    """Search documents written as JSON lines, some hundred to a file, and read back."""
    path = scratch_path(c.spark, "documents")
    docs = S.search_documents(c.v_typed, c.v_labels, c.v_entities)
    T.write_documents(docs, path, 500)
    return c.spark.read.schema(docs.schema).json(path).select(
        "wikidata_id", F.array_join("types", ",").alias("types"), F.array_join("labels", ",").alias("labels")
    )


# --- imports over stored tables -------------------------------------------------------------

_TYPES = {
    "Position": EntityType("Position", ["P1"], ["P5", "P11"]), "Location": EntityType("Location", ["P2", "P3"]),
    "Language": EntityType("Language", ["P4"], ["P4"]),
}


def _sets_sql() -> str:
    trees, parts = [], []
    for name, t in _TYPES.items():
        inside, ignored = f"in_{name}", f"ig_{name}"
        trees.append(closure_sql(inside, t.roots))
        parts.append(f"SELECT '{name}' AS type, wikidata_id AS class_id, FALSE AS ignored FROM {inside}")
        if t.ignore:
            trees.append(closure_sql(ignored, t.ignore))
            parts[-1] += f" WHERE wikidata_id NOT IN (SELECT wikidata_id FROM {ignored})"
            parts.append(f"SELECT '{name}', wikidata_id, TRUE FROM {ignored}")
    return f"WITH RECURSIVE {', '.join(trees)} {' UNION ALL '.join(parts)}"


@query(_sets_sql())
def class_sets_config(c: Catalog) -> DataFrame:
    """Class sets of several types, closed in one loop."""
    return H.class_sets(c.v_entities, c.v_edges, _TYPES)


def _imported(c: Catalog) -> I.PoliticianImport:
    return I.import_politicians(
        entities(c), as_of(), c.v_positions, c.v_countries, c.v_locations, c.v_projects, c.v_politicians
    )


# stored facts: some statements of the dump with an old value, partly deleted, and one without statement
_STORED_FACTS = f"""
    SELECT 'old-' || statement_id AS id, type, 'old' AS value, entity_id, statement_id,
           CASE WHEN ascii(right(statement_id, 1)) % 2 = 0 THEN {AS_OF} END AS deleted_at
    FROM ({_FACT_ROWS}) f WHERE statement_id IS NOT NULL AND ascii(right(statement_id, 1)) % 3 <> 0
    UNION ALL SELECT 'own', 'P27', NULL, 'N1', NULL, NULL"""


_FACT_COLUMNS = (
    "id string, politician_id string, type string, value string, entity_id string, statement_id string, "
    "deleted_at timestamp"
)


@query(f"""
    SELECT coalesce(s.id, sha256('statement|' || f.statement_id)) AS id, f.type, f.value, f.entity_id, f.statement_id,
           s.deleted_at IS NOT NULL AS deleted
    FROM ({_FACT_ROWS}) f LEFT JOIN ({_STORED_FACTS}) s ON s.statement_id = f.statement_id WHERE f.statement_id IS NOT NULL
    UNION ALL SELECT id, type, value, entity_id, statement_id, FALSE FROM ({_STORED_FACTS}) x WHERE statement_id IS NULL""")
def import_properties(c: Catalog) -> DataFrame:
    """Facts of a dump over stored ones: values overwritten, ids and soft deletes kept."""
    found = _imported(c).properties
    last = F.ascii(F.right("statement_id", F.lit(1)))
    stored = found.where(last % 3 != 0).select(
        F.concat(F.lit("old-"), "statement_id").alias("id"), F.lit("pol-old").alias("politician_id"), "type",
        F.lit("old").alias("value"), "entity_id", "statement_id", F.when(last % 2 == 0, as_of()).alias("deleted_at"),
    )
    own = c.spark.createDataFrame([("own", "pol-1", "P27", None, "N1", None, None)], _FACT_COLUMNS)
    out = I.store("properties", stored.union(own), found)
    return out.select("id", "type", "value", "entity_id", "statement_id", F.col("deleted_at").isNotNull().alias("deleted"))


_SOME_LABELS = "SELECT entity_id, label FROM v_labels WHERE length(label) % 2 = 0 UNION SELECT 'Q0', 'gone'"


@query(f"""
    SELECT entity_id, text AS label FROM v_texts WHERE field = 'labels' AND entity_id IN ({_CHOSEN})
    UNION SELECT entity_id, label FROM ({_SOME_LABELS}) s""")
def import_labels(c: Catalog) -> DataFrame:
    return I.store("labels", c.sql(_SOME_LABELS).distinct(), _imported(c).labels)


_LINK_ROWS = f"""
    SELECT s.wikidata_id, max(s.url) AS url, p.wikidata_id AS wikipedia_project_id FROM ({_SITES}) s
    JOIN v_projects p ON s.prefix || '/' = p.official_website WHERE s.wikidata_id IN ({_CHOSEN}) GROUP BY 1, 3"""

@query(f"""
    SELECT coalesce(o.id, sha256('politician|' || l.wikidata_id)) AS politician_id, l.url, l.wikipedia_project_id
    FROM ({_LINK_ROWS}) l LEFT JOIN v_politicians o ON o.wikidata_id = l.wikidata_id
    UNION ALL SELECT 'pol-none', 'kept', 'W0'""")
def import_links(c: Catalog) -> DataFrame:
    """Page links of a dump over stored ones; they are found once, then read by both sides of the upsert."""
    found = written(_imported(c).links, "links")
    stored = found.where(F.length("url") % 2 == 0).select("politician_id", F.lit("old").alias("url"), "wikipedia_project_id")
    own = c.spark.createDataFrame([("pol-none", "kept", "W0")], stored.schema)
    return I.store("links", stored.union(own), found)
