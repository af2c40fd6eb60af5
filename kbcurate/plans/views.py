"""Knowledge-base shaped views over the bundled tables, in SQL both Spark and DuckDB run.

People are customers, their office terms orders, offices parts, places suppliers, countries
nations; edges, facts, sources, references, evaluations and extractions follow from the keys.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

#: Tables whose rows become long texts, and how many rows one task makes texts of.
NARROW = ["customer", "supplier", "part", "orders"]
ROWS_PER_TASK = 20_000

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
DUMP_TIME = "TIMESTAMP '2024-01-01 00:00:00'"


def days(n: str) -> str:
    return f"INTERVAL '1' DAY * ({n})"


def pad(n: str, size: int) -> str:
    return f"lpad(CAST({n} AS STRING), {size}, '0')"


def time_text(sign: str, y: str, m: str, d: str) -> str:
    return (
        f"{sign} || {pad(y, 4)} || '-' || {pad(m, 2)} || '-' || {pad(d, 2)} || 'T00:00:00Z'"
    )


def date_text(p: str, y: str, m: str, d: str) -> str:
    return (
        f"CASE WHEN {p} = 9 THEN {pad(y, 4)} WHEN {p} = 10 THEN {pad(y, 4)} || '-' || {pad(m, 2)} "
        f"ELSE {pad(y, 4)} || '-' || {pad(m, 2)} || '-' || {pad(d, 2)} END"
    )


def snak(time: str, precision: str) -> str:
    return (
        '\'{"snaktype":"value","datavalue":{"type":"time","value":{"time":"\' || '
        f"{time} || '\",\"precision\":' || CAST({precision} AS STRING) || '}}}}}}'"
    ).replace("}}}}}}", "}}}")


_third = "CAST(floor({k} / 3.0) AS BIGINT)"

VIEWS = {
    "v_entities": f"""
        SELECT wikidata_id, name, CASE WHEN k % 3 = 0 THEN 'about ' || name END AS description,
               {AS_OF} - {days('k % 60')} AS updated_at,
               CASE WHEN k % 13 = 0 AND kind IN ('N', 'C', 'S', 'P') THEN {AS_OF} END AS deleted_at, k, kind
        FROM (
            SELECT 'R' AS kind, 'R' || CAST(r_regionkey AS STRING) AS wikidata_id, r_name AS name,
                   CAST(r_regionkey AS BIGINT) AS k FROM region
            UNION ALL SELECT 'N', 'N' || CAST(n_nationkey AS STRING), n_name, CAST(n_nationkey AS BIGINT) FROM nation
            UNION ALL SELECT 'C', 'C' || CAST(c_custkey AS STRING), c_name, c_custkey FROM customer
            UNION ALL SELECT 'S', 'S' || CAST(s_suppkey AS STRING), s_name, s_suppkey FROM supplier
            UNION ALL SELECT 'P', 'P' || CAST(p_partkey AS STRING), p_name, p_partkey FROM part
            UNION ALL SELECT DISTINCT 'L', 'L' || CAST(n_nationkey % 7 AS STRING),
                   'Language ' || CAST(n_nationkey % 7 AS STRING), CAST(n_nationkey % 7 AS BIGINT) FROM nation
            UNION ALL SELECT DISTINCT 'W', 'W' || CAST(n_nationkey % 7 AS STRING),
                   'Edition ' || CAST(n_nationkey % 7 AS STRING), CAST(n_nationkey % 7 AS BIGINT) FROM nation
        ) e""",
    "v_edges": f"""
        SELECT parent_entity_id, child_entity_id, relation_type,
               child_entity_id || '$' || relation_type || '$' || parent_entity_id AS statement_id,
               {AS_OF} - {days('k % 90')} AS updated_at,
               CASE WHEN k % 17 = 16 THEN {AS_OF} END AS deleted_at, k
        FROM (
            SELECT 'P' || CAST(CAST(floor((p_partkey - 1) / 3.0) AS BIGINT) AS STRING) AS parent_entity_id,
                   'P' || CAST(p_partkey AS STRING) AS child_entity_id, 'P279' AS relation_type,
                   p_partkey AS k FROM part WHERE p_partkey > 0
            UNION ALL SELECT 'P' || CAST(max(p_partkey) AS STRING), 'P1', 'P279', CAST(1 AS BIGINT) FROM part
            UNION ALL SELECT 'P' || CAST(p_partkey % 40 AS STRING), 'P' || CAST(p_partkey AS STRING), 'P31',
                   p_partkey FROM part WHERE p_size % 3 = 0
            UNION ALL SELECT 'N' || CAST(s_nationkey AS STRING), 'S' || CAST(s_suppkey AS STRING), 'P31',
                   s_suppkey FROM supplier
            UNION ALL SELECT 'R' || CAST(s_suppkey % 5 AS STRING), 'S' || CAST(s_suppkey AS STRING), 'P131',
                   s_suppkey FROM supplier WHERE s_suppkey % 2 = 0
            UNION ALL SELECT 'R' || CAST(n_regionkey AS STRING), 'N' || CAST(n_nationkey AS STRING), 'P17',
                   CAST(n_nationkey AS BIGINT) FROM nation
            UNION ALL SELECT 'L' || CAST(n_nationkey % 7 AS STRING), 'N' || CAST(n_nationkey AS STRING), 'P37',
                   CAST(n_nationkey AS BIGINT) FROM nation
            UNION ALL SELECT DISTINCT 'L' || CAST(n_nationkey % 7 AS STRING),
                   'W' || CAST(n_nationkey % 7 AS STRING), 'P407', CAST(n_nationkey % 7 AS BIGINT) FROM nation
            UNION ALL SELECT 'L0', 'W3', 'P407', CAST(3 AS BIGINT) FROM nation WHERE n_nationkey = 3
        ) e""",
    "v_countries": """
        SELECT 'N' || CAST(n_nationkey AS STRING) AS wikidata_id, 'n' || CAST(n_nationkey AS STRING) AS iso_code
        FROM nation""",
    "v_languages": """
        SELECT DISTINCT 'L' || CAST(n_nationkey % 7 AS STRING) AS wikidata_id,
               'l' || CAST(n_nationkey % 7 AS STRING) AS iso_639_1,
               'lx' || CAST(n_nationkey % 7 AS STRING) AS iso_639_3 FROM nation""",
    "v_projects": """
        SELECT DISTINCT 'W' || CAST(n_nationkey % 7 AS STRING) AS wikidata_id,
               'https://w' || CAST(n_nationkey % 7 AS STRING) || '.wikipedia.org/' AS official_website
        FROM nation""",
    "v_positions": """
        SELECT 'P' || CAST(p_partkey AS STRING) AS wikidata_id FROM part WHERE p_size % 2 = 1""",
    "v_locations": "SELECT 'S' || CAST(s_suppkey AS STRING) AS wikidata_id FROM supplier",
    "v_politicians": f"""
        SELECT 'pol-' || CAST(c_custkey AS STRING) AS id, 'C' || CAST(c_custkey AS STRING) AS wikidata_id,
               CASE WHEN c_custkey % 37 <> 5 THEN c_custkey END AS wikidata_id_numeric, c_name AS name,
               first_order + {days('10100')} AS enriched_at
        FROM customer LEFT JOIN (
            SELECT o_custkey, min(o_orderdate) AS first_order FROM orders
            WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey
        ) o ON o_custkey = c_custkey""",
    "v_links": """
        SELECT politician_id, wikipedia_project_id,
               'https://w' || substr(wikipedia_project_id, 2) || '.wikipedia.org/wiki/' || CAST(first_order AS STRING) AS url
        FROM (
            SELECT 'pol-' || CAST(o_custkey AS STRING) AS politician_id,
                   'W' || CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 ELSE o_orderkey % 7 END AS STRING)
                       AS wikipedia_project_id,
                   min(o_orderkey) AS first_order
            FROM orders WHERE o_custkey % 19 <> 4 GROUP BY 1, 2
        ) o""",
    # office terms with their date parts (0 where the precision has none)
    "v_terms": f"""
        SELECT k, id, politician_id, entity_id, sp, sy, sm, sd, ep, ey, em, ed,
               CASE WHEN sp IS NOT NULL THEN {time_text("'+'", "sy", "sm", "sd")} END AS start_time,
               CASE WHEN ep IS NOT NULL THEN {time_text("'+'", "ey", "em", "ed")} END AS end_time
        FROM (
            SELECT k, id, politician_id, entity_id, sp, ep,
                   CASE WHEN sp IS NOT NULL THEN year(s) END AS sy,
                   CASE WHEN sp IS NULL THEN NULL WHEN sp >= 10 THEN month(s) ELSE 0 END AS sm,
                   CASE WHEN sp IS NULL THEN NULL WHEN sp >= 11 THEN day(s) ELSE 0 END AS sd,
                   CASE WHEN ep IS NOT NULL THEN year(e) END AS ey,
                   CASE WHEN ep IS NULL THEN NULL WHEN ep >= 10 THEN month(e) ELSE 0 END AS em,
                   CASE WHEN ep IS NULL THEN NULL WHEN ep >= 11 THEN day(e) ELSE 0 END AS ed
            FROM (
                SELECT o_orderkey AS k, 'pos-' || CAST(o_orderkey AS STRING) AS id,
                       'pol-' || CAST(o_custkey AS STRING) AS politician_id,
                       'P' || CAST(o_orderkey % 3 AS STRING) AS entity_id,
                       o_orderdate AS s, o_orderdate + {days('(o_orderkey * 37) % 900')} AS e,
                       CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 31 = 0 THEN NULL
                            ELSE 9 + {_third.format(k='o_orderkey')} % 3 END AS sp,
                       CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 7 = 0 THEN NULL
                            WHEN o_orderkey % 11 = 0 THEN 9
                            ELSE 9 + {_third.format(k='o_orderkey')} % 3 END AS ep
                FROM orders
            ) d
        ) p""",
    "v_births": """
        SELECT c_custkey AS k, 'pol-' || CAST(c_custkey AS STRING) AS politician_id,
               1930 + c_custkey % 60 AS y, 1 + c_custkey % 12 AS m, 1 + c_custkey % 28 AS d,
               9 + c_custkey % 3 AS p FROM customer""",
    "v_properties": f"""
        SELECT id, politician_id, type, value, CAST(value_precision AS INT) AS value_precision,
               entity_id, CASE WHEN pending THEN NULL ELSE id || '$s' END AS statement_id,
               qualifiers_json, CAST(NULL AS STRING) AS references_json,
               TIMESTAMP '2023-01-01 00:00:00' + INTERVAL '1' SECOND * (k % 1000) AS created_at,
               {AS_OF} - {days('k % 90')} AS updated_at,
               CASE WHEN k % 11 = 10 THEN {AS_OF} END AS deleted_at
        FROM (
            SELECT 'cit-' || CAST(c_custkey AS STRING) AS id, 'pol-' || CAST(c_custkey AS STRING) AS politician_id,
                   'P27' AS type, CAST(NULL AS STRING) AS value, CAST(NULL AS BIGINT) AS value_precision,
                   'N' || CAST(c_nationkey AS STRING) AS entity_id, c_custkey % 4 = 0 AS pending,
                   CAST(NULL AS STRING) AS qualifiers_json, c_custkey AS k
            FROM customer WHERE c_custkey % 5 <> 0
            UNION ALL
            SELECT 'ci2-' || CAST(c_custkey AS STRING), 'pol-' || CAST(c_custkey AS STRING), 'P27', NULL, NULL,
                   'N' || CAST((c_nationkey + 1) % 25 AS STRING), c_custkey % 2 = 0, NULL, c_custkey
            FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 10 <> 0
            UNION ALL
            SELECT 'dob-' || CAST(k AS STRING), politician_id, 'P569',
                   {time_text("CASE WHEN k % 29 = 7 THEN '' ELSE '+' END", "y",
                              "CASE WHEN p >= 10 THEN m ELSE 0 END",
                              "CASE WHEN p = 11 THEN d ELSE 0 END")},
                   CASE WHEN k % 53 = 9 THEN NULL ELSE p END, NULL, k % 2 = 0, NULL, k FROM v_births
            UNION ALL
            SELECT 'pob-' || CAST(c_custkey AS STRING), 'pol-' || CAST(c_custkey AS STRING), 'P19', NULL, NULL,
                   'S' || CAST(c_custkey % 10 AS STRING), c_custkey % 6 = 0, NULL, c_custkey FROM customer
            UNION ALL
            SELECT id, politician_id, 'P39', NULL, NULL, entity_id, k % 4 = 0,
                   CASE WHEN sp IS NOT NULL AND ep IS NOT NULL
                        THEN '{{"P580":[' || {snak('start_time', 'sp')} || '],"P582":[' || {snak('end_time', 'ep')} || ']}}'
                        WHEN sp IS NOT NULL THEN '{{"P580":[' || {snak('start_time', 'sp')} || ']}}'
                        WHEN ep IS NOT NULL THEN '{{"P582":[' || {snak('end_time', 'ep')} || ']}}' END,
                   k FROM v_terms
        ) f""",
    "v_sources": f"""
        SELECT 'src-' || CAST(p_partkey AS STRING) AS id,
               'https://w' || CAST(p_partkey % 7 AS STRING) || '.wikipedia.org/wiki/' || replace(p_name, ' ', '_')
                   || '_' || CAST(p_partkey AS STRING) AS url,
               CASE WHEN p_partkey % 3 <> 0 THEN 'W' || CAST(p_partkey % 7 AS STRING) END AS wikipedia_project_id,
               CASE WHEN p_partkey % 2 = 0 THEN 'https://w.example/index?oldid=' || CAST(p_partkey AS STRING) END
                   AS permanent_url,
               {DUMP_TIME} + {days('p_partkey % 28')} AS fetch_timestamp,
               CASE WHEN p_partkey % 9 = 0 THEN 'PROCESSING' ELSE 'DONE' END AS status,
               CASE WHEN p_partkey % 10 = 0 THEN 'FETCH_ERROR' WHEN p_partkey % 10 = 1 THEN 'TIMEOUT' END AS error,
               CASE WHEN p_partkey % 10 = 0 AND p_partkey % 40 <> 0 THEN 404
                    WHEN p_partkey % 70 = 3 THEN 500 END AS http_status_code
        FROM part""",
    "v_source_languages": """
        SELECT 'src-' || CAST(p_partkey AS STRING) AS source_id, 'L' || CAST(p_partkey % 7 AS STRING) AS language_id
        FROM part WHERE p_partkey % 3 <> 0""",
    "v_quotes": """
        SELECT DISTINCT 'pos-' || CAST(l_orderkey AS STRING) AS property_id,
               'src-' || CAST(l_partkey AS STRING) AS source_id,
               l_returnflag || ' ' || CAST(l_suppkey % 4 AS STRING) AS quote
        FROM lineitem""",
    "v_references": "SELECT DISTINCT property_id, source_id FROM v_quotes",
    "v_politician_sources": """
        SELECT DISTINCT 'pol-' || CAST(o_custkey AS STRING) AS politician_id,
               'src-' || CAST(l_partkey AS STRING) AS source_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_evaluations": """
        SELECT 'ev-' || CAST(event_id AS STRING) AS id, 'user-' || CAST(user_id AS STRING) AS user_id,
               event_type = 'purchase' AS is_accepted,
               'pos-' || CAST((event_id * 7) % (SELECT count(*) FROM orders) AS STRING) AS property_id,
               ts AS created_at
        FROM events WHERE event_type IN ('purchase', 'error')""",
    "v_labels": """
        SELECT 'C' || CAST(c_custkey AS STRING) AS entity_id, c_name AS label FROM customer
        UNION ALL SELECT 'P' || CAST(p_partkey AS STRING), p_name FROM part
        UNION ALL SELECT 'P' || CAST(p_partkey AS STRING), lower(p_type) || ' ' || p_name FROM part
        UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), s_name FROM supplier
        UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), lower(s_name) FROM supplier
        UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), n_name FROM nation
        UNION ALL SELECT 'L' || CAST(n_nationkey % 7 AS STRING), 'Language' FROM nation""",
    "v_typed": """
        SELECT wikidata_id, 'Country' AS type FROM v_countries
        UNION ALL SELECT wikidata_id, 'Location' FROM v_locations
        UNION ALL SELECT wikidata_id, 'Position' FROM v_positions
        UNION ALL SELECT wikidata_id, 'Politician' FROM v_politicians""",
    "v_extractions": f"""
        SELECT k AS seq, politician_id, source_id, kind, entity_id,
               CASE WHEN kind <> 'P569' THEN NULL WHEN k % 97 = 1 THEN 'about 1950'
                    ELSE {date_text('vp', 'y + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END', 'm', 'd')} END AS value,
               CASE WHEN kind = 'P39' AND k % 23 <> 0 THEN {date_text('vp', 'year(s)', 'month(s)', 'day(s)')} END AS start_date,
               CASE WHEN kind = 'P39' AND k % 23 <> 0 AND k % 4 <> 0 THEN {date_text('vp', 'year(e)', 'month(e)', 'day(e)')} END AS end_date
        FROM (
            SELECT o_orderkey AS k, politician_id, 'src-' || CAST(o_orderkey % 100 AS STRING) AS source_id,
                   CASE o_orderkey % 5 WHEN 0 THEN 'P569' WHEN 1 THEN 'P27' WHEN 2 THEN 'P19' ELSE 'P39' END AS kind,
                   CASE o_orderkey % 5 WHEN 0 THEN NULL
                        WHEN 1 THEN 'N' || CAST(o_orderkey % 25 AS STRING)
                        WHEN 2 THEN 'S' || CAST(o_orderkey % 10 AS STRING)
                        ELSE 'P' || CAST(o_orderkey % 3 AS STRING) END AS entity_id,
                   9 + o_orderkey % 3 AS vp, y, m, d,
                   o_orderdate - {days('(o_orderkey * 13) % 40')} AS s,
                   o_orderdate + {days('(o_orderkey * 37) % 900 + o_orderkey % 3')} AS e
            FROM orders JOIN v_births b ON b.k = o_custkey
        ) x""",
    # contents of the dump: texts, page titles and claims, one row each
    "v_texts": """
        SELECT entity_id, field, lang, ord, text FROM (
            SELECT wikidata_id AS entity_id, 'labels' AS field, 'fr' AS lang, 0 AS ord,
                   CASE WHEN k % 4 = 0 THEN 'fr ' || name ELSE name END AS text, k
            FROM v_entities WHERE k % 4 IN (0, 2)
            UNION ALL SELECT wikidata_id, 'labels', 'de', 0, 'de ' || name, k FROM v_entities WHERE k % 4 = 1
            UNION ALL SELECT wikidata_id, 'labels', 'mul', 1, name, k FROM v_entities WHERE k % 4 = 0
            UNION ALL SELECT wikidata_id, 'labels', 'en', 1, name, k FROM v_entities WHERE k % 4 IN (1, 3)
            UNION ALL SELECT wikidata_id, 'labels', 'es', 1, name, k FROM v_entities WHERE k % 4 = 2
        ) t WHERE k % 20 <> 19
        UNION ALL SELECT wikidata_id, 'descriptions', 'en', 0, description FROM v_entities
        WHERE description IS NOT NULL""",
    "v_sitelinks": """
        SELECT entity_id, site, title FROM (
            SELECT 'C' || CAST(c_custkey AS STRING) AS entity_id, 'w' || CAST(c_custkey % 7 AS STRING) || 'wiki' AS site,
                   replace(c_name, '#', ' ') AS title FROM customer
            UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'w' || CAST((c_custkey + 1) % 7 AS STRING) || 'wiki',
                   replace(c_name, '#', ' no ') FROM customer WHERE c_custkey % 2 = 0
            UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'w9wiki', c_name FROM customer WHERE c_custkey % 3 = 0
            UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'commonswiki', c_name FROM customer WHERE c_custkey % 4 = 0
            UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'simplewiki', c_name FROM customer WHERE c_custkey % 4 = 1
            UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'w1wikiquote', c_name FROM customer WHERE c_custkey % 5 = 1
        ) s""",
    "v_claims": f"""
        SELECT entity_id, prop, ord, rank, statement_id, value_id,
               CASE WHEN p IS NOT NULL THEN {time_text("'+'", "y", "m", "d")} END AS time, p AS precision,
               text, y, m, d
        FROM (
            SELECT child_entity_id AS entity_id, relation_type AS prop, 0 AS ord,
                   CASE k % 5 WHEN 0 THEN 'preferred' WHEN 1 THEN 'deprecated' WHEN 2 THEN NULL ELSE 'normal' END AS rank,
                   CASE WHEN k % 23 <> 1 THEN statement_id END AS statement_id, parent_entity_id AS value_id,
                   CAST(NULL AS BIGINT) AS p, CAST(NULL AS BIGINT) AS y, CAST(NULL AS BIGINT) AS m,
                   CAST(NULL AS BIGINT) AS d, CAST(NULL AS STRING) AS text FROM v_edges
            UNION ALL SELECT 'P' || CAST(p_partkey AS STRING), 'P279', 1, 'normal',
                   'P' || CAST(p_partkey AS STRING) || '$x', 'P' || CAST((p_partkey * 7) % 50 AS STRING),
                   NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 4 = 1
            UNION ALL SELECT 'P' || CAST(p_partkey AS STRING), 'P31', 2, 'normal',
                   'P' || CAST(p_partkey AS STRING) || '$n', NULL, NULL, NULL, NULL, NULL, NULL
                   FROM part WHERE p_partkey % 8 = 3
            UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'P31', 0, 'normal', 'C' || CAST(c_custkey AS STRING) || '$h',
                   CASE WHEN c_custkey % 6 = 5 THEN 'Q43229' ELSE 'Q5' END, NULL, NULL, NULL, NULL, NULL FROM customer
            UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'P106', 0, 'normal', 'C' || CAST(c_custkey AS STRING) || '$o',
                   CASE WHEN c_custkey % 2 = 0 THEN 'Q82955' ELSE 'Q1' END, NULL, NULL, NULL, NULL, NULL FROM customer
            UNION ALL SELECT 'C' || substr(politician_id, 5), 'P39', CAST(substr(entity_id, 2) AS INT),
                   CASE WHEN min(k) % 9 = 8 THEN 'deprecated' ELSE 'normal' END, 'C' || CAST(min(k) AS STRING) || '$p',
                   entity_id, NULL, NULL, NULL, NULL, NULL
                   FROM v_terms GROUP BY politician_id, entity_id
            UNION ALL SELECT 'C' || CAST(k AS STRING), 'P569', 0, 'normal', 'C' || CAST(k AS STRING) || '$b', NULL,
                   p, y - CASE WHEN k % 10 = 3 THEN 60 ELSE 0 END, CASE WHEN p >= 10 THEN m ELSE 0 END,
                   CASE WHEN p = 11 THEN d ELSE 0 END, NULL FROM v_births
            UNION ALL SELECT 'C' || CAST(k AS STRING), 'P569', 1, 'preferred', 'C' || CAST(k AS STRING) || '$c', NULL,
                   9, 1961, 0, 0, NULL FROM v_births WHERE k % 8 = 0
            UNION ALL SELECT 'C' || CAST(k AS STRING), 'P570', 0, 'normal', 'C' || CAST(k AS STRING) || '$d', NULL,
                   p, 2015 + k % 9, CASE WHEN p >= 10 THEN m ELSE 0 END, CASE WHEN p = 11 THEN d ELSE 0 END, NULL
                   FROM v_births WHERE k % 4 = 0
            UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'P27', 0, 'normal', 'C' || CAST(c_custkey AS STRING) || '$z',
                   'N' || CAST(c_nationkey AS STRING), NULL, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 3 <> 0
            UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'P19', 0, 'normal', 'C' || CAST(c_custkey AS STRING) || '$l',
                   'S' || CAST(c_custkey % 20 AS STRING), NULL, NULL, NULL, NULL, NULL FROM customer
            UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'P297', 0, 'normal', 'N' || CAST(n_nationkey AS STRING) || '$i',
                   NULL, NULL, NULL, NULL, NULL, CASE WHEN n_nationkey % 5 <> 0 THEN 'n' || CAST(n_nationkey AS STRING) END
                   FROM nation
            UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'P297', 1, 'normal', 'N' || CAST(n_nationkey AS STRING) || '$j',
                   NULL, NULL, NULL, NULL, NULL, 'alt' || CAST(n_nationkey AS STRING) FROM nation WHERE n_nationkey % 2 = 0
            UNION ALL SELECT wikidata_id, 'P218', 0, 'normal', wikidata_id || '$1', NULL, NULL, NULL, NULL, NULL, iso_639_1
                   FROM v_languages
            UNION ALL SELECT wikidata_id, 'P220', 0, NULL, wikidata_id || '$3', NULL, NULL, NULL, NULL, NULL, iso_639_3
                   FROM v_languages
            UNION ALL SELECT wikidata_id, 'P31', 0, 'normal', wikidata_id || '$31',
                   CASE WHEN wikidata_id = 'W6' THEN 'Q210588' ELSE 'Q10876391' END, NULL, NULL, NULL, NULL, NULL
                   FROM v_projects
            UNION ALL SELECT wikidata_id, 'P856', 0, 'normal', wikidata_id || '$w', NULL, NULL, NULL, NULL, NULL,
                   CASE WHEN wikidata_id <> 'W5' THEN official_website END FROM v_projects
            UNION ALL SELECT wikidata_id, 'P856', 1, 'normal', wikidata_id || '$v', NULL, NULL, NULL, NULL, NULL,
                   official_website FROM v_projects
        ) c""",
    "v_truthy": """
        SELECT entity_id, prop, ord, rank, statement_id, value_id, time, precision, text, y, m, d FROM (
            SELECT *, max(CASE WHEN rank = 'preferred' THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, prop) AS pref
            FROM v_claims WHERE coalesce(rank, 'normal') <> 'deprecated'
        ) r WHERE pref = 0 OR rank = 'preferred'""",
    # pairs of imprecise dates of all precisions, some null, some before the era
    "v_date_pairs": f"""
        SELECT k, ap, ay, am, ad, bp, bq, bm, bd,
               CASE WHEN ap IS NOT NULL THEN {time_text("asign", "ay", "am", "ad")} END AS a_time,
               CASE WHEN bp IS NOT NULL THEN {time_text("'+'", "bq", "bm", "bd")} END AS b_time,
               asign
        FROM (
            SELECT o_orderkey AS k,
                   CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE 5 + o_orderkey % 8 END AS ap,
                   CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE 5 + CAST(floor(o_orderkey / 8.0) AS BIGINT) % 8 END AS bp,
                   CASE WHEN o_orderkey % 5 < 3 THEN year(o_orderdate)
                        ELSE 1890 + o_orderkey % 130 END AS ay,
                   CASE WHEN 5 + o_orderkey % 8 >= 10 THEN month(o_orderdate) ELSE 0 END AS am,
                   CASE WHEN 5 + o_orderkey % 8 >= 11 THEN day(o_orderdate) ELSE 0 END AS ad,
                   year(o_orderdate + {days('o_orderkey % 2 * 31')}) AS bq,
                   CASE WHEN 5 + CAST(floor(o_orderkey / 8.0) AS BIGINT) % 8 >= 10
                        THEN month(o_orderdate + {days('o_orderkey % 2 * 31')}) ELSE 0 END AS bm,
                   CASE WHEN 5 + CAST(floor(o_orderkey / 8.0) AS BIGINT) % 8 >= 11
                        THEN day(o_orderdate + {days('o_orderkey % 2')}) ELSE 0 END AS bd,
                   CASE WHEN o_orderkey % 41 = 0 THEN '-' ELSE '+' END AS asign
            FROM orders
        ) p""",
}


def _needed(sql: str) -> list[str]:
    """Views a statement needs, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_\w+", text)):
            if name in VIEWS and name not in ordered:
                visit(VIEWS[name])
                ordered.append(name)

    visit(sql)
    return ordered


def with_views(sql: str) -> str:
    """A statement with the views it uses as common table expressions; a statement that starts
    with WITH (or WITH RECURSIVE) has its own put after them."""
    sql = sql.strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", sql, re.I)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in _needed(sql)]
    if own:
        head = "WITH RECURSIVE " if own.group(1) else "WITH "
        return head + ", ".join([*ctes, sql[own.end():]])
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql


class Catalog:
    """The bundled tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._seen: dict[str, DataFrame] = {}
        self._parts: dict[str, int] = {}

    _open: dict[str, Catalog] = {}

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Catalog:
        """The catalog of a folder; its view definitions (plans, not rows) are made once."""
        found = cls._open.get(folder)
        if found is None or found.spark is not spark:
            found = cls._open[folder] = cls(spark, folder)
        return found

    def shared(self, name: str, make: Callable[[Catalog], DataFrame]) -> DataFrame:
        if name not in self._seen:
            self._seen[name] = make(self)
        return self._seen[name]

    def read(self, name: str) -> DataFrame:
        """A bundled table as its file lies, for what is grouped at once."""
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        """A bundled table. Those whose rows the views make long texts of are put in parts first: a narrow
        file is one row group, and so one task, however many rows it has."""
        if name not in self._seen:
            table = self.read(name)
            parts = self.parts(name) if name in NARROW else 1
            self._seen[name] = table.repartition(parts) if parts > 1 else table
        return self._seen[name]

    def parts(self, name: str) -> int:
        """In how many tasks a table's rows are to be made texts of."""
        if name not in self._parts:
            rows = self.read(name).count()
            self._parts[name] = max(1, -(-rows // ROWS_PER_TASK))
        return self._parts[name]

    def sql(self, statement: str) -> DataFrame:
        text = with_views(statement)
        for name in TABLES:
            if re.search(rf"\b{name}\b", text):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("v_") and name in VIEWS:
            if name not in self._seen:
                self._seen[name] = self.sql(f"SELECT * FROM {name}")
            return self._seen[name]
        raise AttributeError(name)
