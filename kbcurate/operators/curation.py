"""Review decisions, what they send out, and collecting records gone from two dumps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from kbcurate.functions import dates as D
from kbcurate.operators.ranks import gather
from kbcurate.schemas import DATE_TYPES, FACT_TYPES
from kbcurate.sources.tables import last_per_key

ACTION_ITEM = (
    "struct<action:string,id:string,type:string,value:string,value_precision:int,"
    "entity_id:string,qualifiers_json:string>"
)
ACTION_MAP = f"map<string,array<{ACTION_ITEM}>>"


# --- applying actions -----------------------------------------------------------------------


@dataclass(frozen=True)
class Applied:
    evaluations: DataFrame
    new_facts: DataFrame
    errors: DataFrame


def action_rows(requests: DataFrame) -> DataFrame:
    """One row per action of requests ``(request_id, user_id, actions)``, where ``actions`` maps
    a politician to its items."""
    return (
        requests.select("request_id", "user_id", F.explode("actions").alias("politician_id", "items"))
        .select("request_id", "user_id", "politician_id", F.posexplode("items").alias("pos", "item"))
        .select("request_id", "user_id", "politician_id", "pos", "item.*")
    )


def apply_actions(
    requests: DataFrame, facts: DataFrame, politicians: DataFrame, as_of: Column
) -> Applied:
    """Accepting or rejecting a known fact gives an evaluation; creating one of a known type for
    a known politician gives a fact and an accepted evaluation; anything else an error row."""
    rows = action_rows(requests)
    key = F.concat_ws("|", "request_id", "politician_id", F.col("pos").cast("string"))
    routed = (
        rows.join(facts.select("id", F.lit(True).alias("_fact")), "id", "left")
        .join(
            politicians.select(F.col("id").alias("politician_id"), F.lit(True).alias("_who")),
            "politician_id", "left",
        )
        .withColumn("_create", F.col("action") == "create")
        .withColumn(
            "error",
            F.when(
                ~F.col("_create") & F.col("_fact").isNull(),
                F.concat(F.lit("Property "), F.coalesce("id", F.lit("")), F.lit(" not found")),
            )
            .when(
                F.col("_create") & ~F.coalesce(F.col("type").isin(FACT_TYPES), F.lit(False)),
                F.concat(F.lit("Unknown property type: "), F.coalesce("type", F.lit(""))),
            )
            .when(
                F.col("_create") & F.col("_who").isNull(),
                F.concat(F.lit("Politician "), F.col("politician_id"), F.lit(" not found")),
            ),
        )
        .withColumn(
            "property_id",
            F.when(F.col("_create"), F.sha2(F.concat_ws("|", F.lit("created"), key), 256))
            .otherwise(F.col("id")),
        )
    )
    good = routed.where(F.col("error").isNull())
    return Applied(
        good.select(
            F.sha2(F.concat_ws("|", F.lit("evaluation"), key), 256).alias("id"), "user_id",
            (F.col("action") != "reject").alias("is_accepted"), "property_id",
            as_of.alias("created_at"),
        ),
        good.where("_create").select(
            F.col("property_id").alias("id"), "politician_id", "type", "value", "value_precision",
            "entity_id", "qualifiers_json", F.lit(None).cast("string").alias("statement_id"),
            as_of.alias("created_at"),
        ),
        routed.where(F.col("error").isNotNull()).select("request_id", "politician_id", "pos", "error"),
    )


def fold_actions(log: DataFrame) -> DataFrame:
    """Open actions of a review form after a log ``(politician_id, id, seq, action)`` of create,
    accept and reject clicks.

    The same click again takes an action back, another replaces it, and rejecting a created fact
    removes it (that click is used up). Replaying is not needed: after the last click of the other
    kind, an odd number of clicks leaves the action on and an even number off. All steps are
    aggregates, so a fact with any number of clicks costs no more than its rows.
    """
    keys = ["politician_id", "id"]

    def last(kind: str) -> Column:
        return F.max(F.when(F.col("action") == kind, F.col("seq")))

    created = log.groupBy(*keys).agg(last("create").alias("created_at"))
    log = log.join(created, keys)
    removal = log.groupBy(*keys).agg(
        F.min(
            F.when((F.col("action") == "reject") & (F.col("seq") > F.col("created_at")), F.col("seq"))
        ).alias("removed_at")
    )
    clicks = log.join(removal, keys).where(
        (F.col("action") != "create") & ~F.col("seq").eqNullSafe(F.col("removed_at"))
    )
    ends = clicks.groupBy(*keys).agg(
        F.max_by("action", "seq").alias("last_action"),
        F.least(last("accept"), last("reject")).alias("other_until"),
        F.count_if(F.col("action") == "accept").alias("_a"),
        F.count_if(F.col("action") == "reject").alias("_r"),
    ).withColumn(
        "other_until", F.when((F.col("_a") > 0) & (F.col("_r") > 0), F.col("other_until"))
    ).drop("_a", "_r")
    runs = (
        clicks.join(ends, keys)
        .where(F.col("other_until").isNull() | (F.col("seq") > F.col("other_until")))
        .groupBy(*keys, "last_action").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") % 2 == 1)
        .select(*keys, F.col("last_action").alias("action"))
    )
    kept = created.join(removal, keys).where(
        F.col("created_at").isNotNull() & F.col("removed_at").isNull()
    ).select(*keys, F.lit("create").alias("action"))
    return kept.unionByName(runs)


# --- outbox ---------------------------------------------------------------------------------


def decide_pushes(evaluations: DataFrame, facts: DataFrame) -> DataFrame:
    """What each evaluation sends out: accepted new facts create a statement, rejected existing
    ones are deprecated, rejected new ones only deleted here, accepted existing ones nothing."""
    existing = F.coalesce("statement_id", F.lit("")) != ""
    push = (
        F.when(F.col("is_accepted") & ~existing, "create_statement")
        .when(~F.col("is_accepted") & existing, "deprecate_statement")
        .when(~F.col("is_accepted"), "soft_delete")
        .otherwise("none")
    )
    known = facts.select(
        F.col("id").alias("property_id"), "politician_id", "type", "statement_id"
    )
    return evaluations.select(
        F.col("id").alias("evaluation_id"), "property_id", "is_accepted"
    ).join(known, "property_id").withColumn("push", push)


def settle_pushes(facts: DataFrame, outbox: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """Facts after the outbox ran: ``results(evaluation_id, ok, statement_id)``. A created
    statement's id is stored; a deprecation deletes only if it succeeded; a plain rejection
    deletes anyway."""
    done = outbox.join(
        results.select("evaluation_id", "ok", F.col("statement_id").alias("created_id")),
        "evaluation_id", "left",
    )
    ok = F.coalesce("ok", F.lit(False))
    effects = done.groupBy(F.col("property_id").alias("id")).agg(
        F.max(F.when((F.col("push") == "create_statement") & ok, F.col("created_id"))).alias("_sid"),
        F.bool_or(
            (F.col("push") == "soft_delete") | ((F.col("push") == "deprecate_statement") & ok)
        ).alias("_gone"),
    )
    return facts.join(effects, "id", "left").withColumn(
        "statement_id", F.coalesce("_sid", "statement_id")
    ).withColumn(
        "deleted_at",
        F.when(F.coalesce("_gone", F.lit(False)) & F.col("deleted_at").isNull(), at)
        .otherwise(F.col("deleted_at")),
    ).select(*facts.columns)


def _json_text(text: Column) -> Column:
    """A string as a JSON literal."""
    array = F.to_json(F.array(text))
    return F.substr(array, F.lit(2), F.length(array) - 2)


_QUALIFIERS = "map<string,array<struct<snaktype:string,datavalue:struct<type:string,value:string>>>>"

# Value types whose JSON is an object.
OBJECT_VALUES = ["time", "quantity", "globecoordinate", "monolingualtext"]


def rest_qualifiers(qualifiers_json: Column) -> Column:
    """Qualifiers in the shape statements are written in: a JSON array; item values become their
    id, values of other kinds stay as they are, unknown and missing values keep their kind."""

    def content(v: Column) -> Column:
        return (
            F.when(v["type"] == "wikibase-entityid",
                   _json_text(F.get_json_object(v["value"], "$.id")))
            .when(v["type"].isin(OBJECT_VALUES), v["value"])
            .otherwise(_json_text(v["value"]))
        )

    def snak(prop: Column, q: Column) -> Column:
        filled = (q["snaktype"] == "value") & q["datavalue"].isNotNull()
        value = F.when(
            filled, F.concat(F.lit('{"type":"value","content":'), content(q["datavalue"]), F.lit("}"))
        ).otherwise(
            F.concat(F.lit('{"type":'), _json_text(F.coalesce(q["snaktype"], F.lit("value"))), F.lit("}"))
        )
        return F.concat(
            F.lit('{"property":{"id":'), _json_text(prop), F.lit('},"value":'), value, F.lit("}")
        )

    entries = F.map_entries(F.from_json(qualifiers_json, _QUALIFIERS))
    flat = F.flatten(
        F.transform(entries, lambda e: F.transform(e["value"], lambda q: snak(e["key"], q)))
    )
    return F.when(
        F.size(flat) > 0, F.concat(F.lit("["), F.array_join(flat, ","), F.lit("]"))
    )


def statement_payload(facts: DataFrame) -> DataFrame:
    """(id, property, value, qualifiers, error) of facts to create as statements."""
    date = D.imprecise(F.col("value"), F.col("value_precision"))
    content = F.when(F.col("type").isin(DATE_TYPES), D.time_value(date)).otherwise(
        _json_text(F.col("entity_id"))
    )
    error = (
        F.when(~F.coalesce(F.col("type").isin(FACT_TYPES), F.lit(False)), "unknown type")
        .when(F.col("type").isin(DATE_TYPES) & date.isNull(), "invalid date")
    )
    return facts.select(
        "id", F.col("type").alias("property"),
        F.when(
            error.isNull(), F.concat(F.lit('{"type":"value","content":'), content, F.lit("}"))
        ).alias("value"),
        rest_qualifiers(F.col("qualifiers_json")).alias("qualifiers"), error.alias("error"),
    )


def reference_blocks(sources: DataFrame) -> DataFrame:
    """(source_id, parts): the reference a source gives, as a JSON array. Pages of an edition cite
    their permanent address if known and the edition, others their address; all the fetch date.
    """

    def part(prop: str, content: Column) -> Column:
        return F.concat(
            F.lit(f'{{"property":{{"id":"{prop}"}},"value":{{"type":"value","content":'),
            content, F.lit("}}"),
        )

    edition = F.col("wikipedia_project_id").isNotNull()
    permanent = F.coalesce("permanent_url", F.lit("")) != ""
    fetched = D.parse_date(F.date_format("fetch_timestamp", "yyyy-MM-dd"))
    parts = F.array(
        F.when(edition & permanent, part("P4656", _json_text(F.col("permanent_url")))),
        F.when(edition, part("P143", _json_text(F.col("wikipedia_project_id")))),
        F.when(~edition, part("P854", _json_text(F.col("url")))),
        F.when(fetched.isNotNull(), part("P813", D.time_value(fetched))),
    )
    kept = F.filter(parts, lambda p: p.isNotNull())
    return sources.select(
        F.col("id").alias("source_id"),
        F.concat(F.lit("["), F.array_join(kept, ","), F.lit("]")).alias("parts"),
    )


# --- two-dump garbage collection ------------------------------------------------------------


def latest_two_dumps(dumps: DataFrame) -> DataFrame:
    return dumps.orderBy(F.desc("last_modified"), "id").limit(2)


def previous_dump_time(dumps: DataFrame) -> DataFrame:
    """One row: when the dump before the latest was made; null with fewer than two dumps."""
    return latest_two_dumps(dumps).agg(
        F.when(F.count(F.lit(1)) == 2, F.min("last_modified")).alias("previous")
    )


def missing(table: DataFrame, seen: DataFrame, key: str, previous: Column) -> DataFrame:
    """Ids of live rows that this dump no longer has and that are no newer than the previous
    dump. Null keys are never missing; a null ``previous`` (a first dump) makes nothing missing.
    """
    candidates = table.where(
        F.col("deleted_at").isNull() & F.col(key).isNotNull() & (F.col("updated_at") <= previous)
    ).select(key)
    return candidates.join(seen.select(key), key, "left_anti")


def gc_table(table: DataFrame, seen: DataFrame, key: str, previous: Column, at: Column) -> DataFrame:
    """The table with missing rows soft-deleted, in one join with the ids seen."""
    marks = seen.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_seen", F.lit(True))
    gone = F.col("_seen").isNull() & F.col(key).isNotNull() & F.col("deleted_at").isNull() & (
        F.col("updated_at") <= previous
    )
    return table.join(marks, key, "left").withColumn(
        "deleted_at", F.when(gone, at).otherwise(F.col("deleted_at"))
    ).select(*table.columns)


@dataclass(frozen=True)
class Collected:
    entities: DataFrame
    facts: DataFrame
    relations: DataFrame
    index_deletes: DataFrame


def run_gc(
    dumps: DataFrame, entities: DataFrame, facts: DataFrame, relations: DataFrame,
    seen_entities: DataFrame, seen_statements: DataFrame, at: Column,
) -> Collected:
    """Garbage collection after an import. With a single dump nothing is deleted. The ids seen
    belong to one import and are not used again."""
    previous = previous_dump_time(dumps).scalar()
    return Collected(
        gc_table(entities, seen_entities, "wikidata_id", previous, at),
        gc_table(facts, seen_statements, "statement_id", previous, at),
        gc_table(relations, seen_statements, "statement_id", previous, at),
        missing(entities, seen_entities, "wikidata_id", previous),
    )


# --- data moves -----------------------------------------------------------------------------


def explode_labels(entities: DataFrame) -> DataFrame:
    """Label arrays to distinct (entity_id, label) rows."""
    return entities.select(
        F.col("wikidata_id").alias("entity_id"), F.explode("labels").alias("label")
    ).distinct()


def collect_labels(labels: DataFrame) -> DataFrame:
    """Label rows back to one sorted array per entity, as its dump document held them."""
    return gather(labels.distinct(), ["entity_id"], F.col("label"), "labels")


def backfill_links(rows: DataFrame, left: str, right: str) -> DataFrame:
    """A link table from a nullable foreign key column."""
    return rows.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(left, right).distinct()


def keep_one(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per group, the last by ``order``."""
    return last_per_key(rows, keys, order)


def deletable_copies(facts: DataFrame, evaluations: DataFrame, keys: list[str]) -> DataFrame:
    """Ids of facts that repeat another of their group: all but the smallest id, evaluated facts
    never among them (they are kept whatever their group)."""
    judged = evaluations.select(F.col("property_id").alias("id")).distinct()
    first = facts.groupBy(*keys).agg(F.min("id").alias("_first"))
    return (
        facts.join(first, keys).where(F.col("id") != F.col("_first")).select("id")
        .join(judged, "id", "left_anti")
    )
