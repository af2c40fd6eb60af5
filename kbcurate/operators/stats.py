"""Coverage, time series, lists and the nested records people review."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window, functions as F

from kbcurate.functions import dates as D
from kbcurate.operators.ranking import citizenships, live_politicians, project_languages
from kbcurate.operators.ranks import gather, spread_rank, tie_break
from kbcurate.schemas import (
    BIRTHPLACE, CITIZENSHIP, COUNTRY, DATE_TYPES, INSTANCE_OF, JURISDICTION, LOCATED_IN, PART_OF,
    POSITION, SUBCLASS_OF,
)
from kbcurate.session import scratch_path, written, written_counted
from kbcurate.sources.tables import live

# Fixed value: name of the coverage row of people without citizenship.
NO_CITIZENSHIP = "No citizenship"


# --- evaluations ----------------------------------------------------------------------------


def evaluation_count(evaluations: DataFrame) -> DataFrame:
    return evaluations.agg(F.count(F.lit(1)).alias("total"))


def cutoff(as_of: Column, days: int) -> Column:
    return as_of - F.make_interval(days=F.lit(days))


def evaluation_timeseries(evaluations: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Accepted and rejected per Monday week: ``days // 7`` weeks up to the current one, weeks
    without any filled with zeros; evaluations before the cutoff or outside the weeks left out."""
    counted = (
        evaluations.where(F.col("created_at") >= cutoff(as_of, days))
        .groupBy(F.date_trunc("week", "created_at").alias("week"))
        .agg(F.count_if("is_accepted").alias("accepted"),
             F.count_if(~F.col("is_accepted")).alias("rejected"))
    )
    this_week = F.date_trunc("week", as_of)
    first = this_week - F.make_interval(weeks=F.lit(days // 7 - 1))
    weeks = evaluations.sparkSession.range(1).select(
        F.explode(F.sequence(first, this_week, F.expr("interval 7 days"))).alias("week")
    )
    return weeks.join(counted, "week", "left").select(
        F.date_format("week", "yyyy-MM-dd").alias("week"),
        F.coalesce("accepted", F.lit(0)).cast("long").alias("accepted"),
        F.coalesce("rejected", F.lit(0)).cast("long").alias("rejected"),
    )


def evaluated_politicians(
    facts: DataFrame, references: DataFrame, evaluations: DataFrame, as_of: Column, days: int
) -> DataFrame:
    """Politicians with a live, referenced fact judged since the cutoff."""
    recent = evaluations.where(F.col("created_at") >= cutoff(as_of, days)).select(
        F.col("property_id").alias("id")
    ).distinct()
    backed = references.select(F.col("property_id").alias("id")).distinct()
    return (
        live(facts).select("id", "politician_id")
        .join(recent, "id", "left_semi").join(backed, "id", "left_semi")
        .select("politician_id").distinct()
    )


def coverage(
    politicians: DataFrame, entities: DataFrame, facts: DataFrame, references: DataFrame,
    evaluations: DataFrame, as_of: Column, days: int,
) -> DataFrame:
    """Per citizenship on the knowledge graph (none included): politicians in total, read since
    the cutoff, and judged since. A politician with two citizenships counts in both.

    (politician, country) pairs are made distinct first, so each count is a plain sum with map-side
    combine and a country with a third of all politicians costs one row per task.
    """
    judged = evaluated_politicians(facts, references, evaluations, as_of, days).select(
        F.col("politician_id").alias("id"), F.lit(1).alias("_judged")
    )
    people = (
        live_politicians(politicians, entities)
        .join(judged, "id", "left")
        .select("id", (F.col("enriched_at") >= cutoff(as_of, days)).alias("read"),
                F.col("_judged").isNotNull().alias("judged"))
    )
    held = (
        citizenships(facts).where(F.col("statement_id").isNotNull())
        .select(F.col("politician_id").alias("id"), "entity_id").distinct()
    )
    counts = (
        people.join(held, "id", "left").groupBy("entity_id")
        .agg(F.count(F.lit(1)).alias("total_count"), F.count_if("read").alias("enriched_count"),
             F.count_if("judged").alias("evaluated_count"))
    )
    names = live(entities).select(F.col("wikidata_id").alias("entity_id"), "name")
    return counts.join(names, "entity_id", "left").select(
        F.col("entity_id").alias("wikidata_id"),
        F.coalesce("name", F.lit(NO_CITIZENSHIP)).alias("name"),
        "total_count", "enriched_count", "evaluated_count",
    )


def coverage_view(cov: DataFrame, sort: str = "total", query: str | None = None) -> DataFrame:
    """Coverage with rounded percentages, searched by name and sorted."""
    rows = cov.where(F.lower("name").contains(query.lower())) if query else cov

    def share(c: str) -> Column:
        pct = F.floor(F.col(c) * 100.0 / F.col("total_count") + 0.5)
        return F.when(F.col("total_count") > 0, pct).otherwise(0).cast("long")

    order = {
        "name": [F.asc("name")], "total": [F.desc("total_count")],
        "processed": [F.desc("enriched_count")], "evaluated": [F.desc("evaluated_count")],
    }[sort]
    return rows.select(
        "*", share("evaluated_count").alias("evaluated_percent"),
        share("enriched_count").alias("enriched_percent"),
    ).orderBy(*order, "name", "wikidata_id")


# --- lists ----------------------------------------------------------------------------------


def languages_with_counts(
    languages: DataFrame, entities: DataFrame, relations: DataFrame, projects: DataFrame,
    links: DataFrame,
) -> DataFrame:
    """Languages with the number of page links in their editions. Links are counted per edition
    before the joins."""
    per_edition = links.groupBy("wikipedia_project_id").agg(F.count(F.lit(1)).alias("n"))
    per_language = (
        project_languages(projects, relations, languages)
        .join(per_edition, "wikipedia_project_id")
        .groupBy(F.col("language_qid").alias("wikidata_id"))
        .agg(F.sum("n").alias("sources_count"))
    )
    names = live(entities).select("wikidata_id", "name")
    return (
        languages.join(names, "wikidata_id").join(per_language, "wikidata_id")
        .select("wikidata_id", "name", "iso_639_1", "iso_639_3", "sources_count")
    )


def countries_with_counts(countries: DataFrame, entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Countries with the number of live citizenships; those without any are absent."""
    counts = citizenships(facts).groupBy(F.col("entity_id").alias("wikidata_id")).agg(
        F.count(F.lit(1)).alias("citizenships_count")
    )
    names = live(entities).select("wikidata_id", "name")
    return countries.select("wikidata_id").join(names, "wikidata_id").join(counts, "wikidata_id")


# Relations a description is made of, in order, with their wording.
DESCRIBED = [
    (INSTANCE_OF, ""), (SUBCLASS_OF, "subclass of "), (PART_OF, "part of "),
    (JURISDICTION, "applies to jurisdiction "), (LOCATED_IN, "located in "), (COUNTRY, "country "),
]


def rich_description(ids: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(wikidata_id, description): an entity's own text, then its named live parents per relation,
    sorted by name. All parents of an entity come from its own document, which bounds the lists.
    """
    wanted = ids.select("wikidata_id").distinct()
    parents = entities.select(
        F.col("wikidata_id").alias("parent_entity_id"), F.col("name").alias("parent")
    ).where(F.coalesce("parent", F.lit("")) != "")
    named = (
        live(relations).select(F.col("child_entity_id").alias("wikidata_id"), "parent_entity_id",
                               "relation_type")
        .where(F.col("relation_type").isin([r for r, _ in DESCRIBED]))
        .join(wanted, "wikidata_id", "left_semi")
        .join(parents, "parent_entity_id")
        .groupBy("wikidata_id")
        .agg(*[
            F.array_join(
                F.array_sort(F.collect_list(F.when(F.col("relation_type") == r, F.col("parent")))),
                ", ",
            ).alias(r)
            for r, _ in DESCRIBED
        ])
    )
    parts = [F.nullif("description", F.lit(""))] + [
        F.when(F.length(r) > 0, F.concat(F.lit(wording), F.col(r))) for r, wording in DESCRIBED
    ]
    return (
        entities.join(wanted, "wikidata_id", "left_semi").select("wikidata_id", "description")
        .join(named, "wikidata_id", "left")
        .select("wikidata_id", F.concat_ws(", ", *parts).alias("description"))
    )


# --- nested records -------------------------------------------------------------------------

_SOURCE = ["url", "url_hash", "fetch_timestamp", "status", "error", "http_status_code"]


def _source_struct() -> Column:
    return F.struct(F.col("source_id").alias("id"), *_SOURCE)


@dataclass(frozen=True)
class PoliticianRecords:
    """``politicians``: one row per politician with its facts; ``references`` (politician_id,
    property_id, source, supporting_quotes) and ``sources`` (politician_id, source) are flat, as
    a fact may have any number of references and a person any number of sources."""

    politicians: DataFrame
    references: DataFrame
    sources: DataFrame


#: Entity names that are broadcast: some megabytes.
FEW_NAMES = 50_000


def _with_names(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with ``entity_name``. A few entities (offices, countries) are named by most facts, so that all
    facts of one would meet in one task: names are cut to the entities that facts name and broadcast if
    they are few. If not, adaptive execution splits what is heavy."""
    named = facts.select("entity_id").where(F.col("entity_id").isNotNull()).distinct()
    names = entities.select(F.col("wikidata_id").alias("entity_id"), F.col("name").alias("entity_name"))
    path = scratch_path(facts.sparkSession, "names")
    few = written_counted(names.join(named, "entity_id", "left_semi"), path) <= FEW_NAMES
    found = facts.sparkSession.read.schema(names.schema).parquet(path)
    return facts.join(F.broadcast(found) if few else found, "entity_id", "left")


def politician_documents(
    politicians: DataFrame, facts: DataFrame, entities: DataFrame, references: DataFrame,
    sources: DataFrame, politician_sources: DataFrame,
) -> PoliticianRecords:
    """Records of the given politicians: their live facts with entity names, the references of
    these facts and the politicians' own sources. A politician's list of facts is bounded by what
    is known of one person."""
    who = politicians.select(F.col("id").alias("politician_id"))
    mine = live(facts).join(who, "politician_id", "left_semi")
    item = F.struct(
        "id", "type", "value", "value_precision", "entity_id", "entity_name", "statement_id",
        "qualifiers_json", "references_json",
    )
    nested = gather(_with_names(mine, entities), ["politician_id"], item, "properties")
    detail = sources.select(F.col("id").alias("source_id"), *_SOURCE)
    refs = references.join(
        mine.select(F.col("id").alias("property_id"), "politician_id"), "property_id"
    ).join(detail, "source_id")
    own = politician_sources.join(who, "politician_id", "left_semi").join(detail, "source_id")
    return PoliticianRecords(
        politicians.join(nested.withColumnRenamed("politician_id", "id"), "id", "left").select(
            "id", "name", "wikidata_id", F.coalesce("properties", F.array()).alias("properties")
        ),
        refs.select("politician_id", "property_id", _source_struct().alias("source"), "supporting_quotes"),
        own.select("politician_id", _source_struct().alias("source")).distinct(),
    )


def politician_view(
    qid: str, languages: list[str] | None, politicians: DataFrame, facts: DataFrame,
    entities: DataFrame, references: DataFrame, sources: DataFrame, source_langs: DataFrame,
    politician_sources: DataFrame,
) -> PoliticianRecords:
    """The record of one live politician; with languages, only facts on the knowledge graph or
    with a source in one of them."""
    who = live_politicians(politicians.where(F.col("wikidata_id") == qid), entities)
    mine = facts.join(who.select(F.col("id").alias("politician_id")), "politician_id", "left_semi")
    if languages:
        spoken = source_langs.where(F.col("language_id").isin(languages)).select("source_id").distinct()
        backed = references.join(spoken, "source_id", "left_semi").select(
            F.col("property_id").alias("id"), F.lit(True).alias("_backed")
        ).distinct()
        mine = mine.join(backed, "id", "left").where(
            F.col("statement_id").isNotNull() | F.col("_backed").isNotNull()
        ).drop("_backed")
    return politician_documents(who, mine, entities, references, sources, politician_sources)


def source_view(
    source_ids: list[str], politicians: DataFrame, politician_sources: DataFrame, facts: DataFrame,
    entities: DataFrame, references: DataFrame, sources: DataFrame,
) -> PoliticianRecords:
    """Politicians of given sources with only the facts, references and sources of those."""
    refs = references.where(F.col("source_id").isin(source_ids))
    listed = politician_sources.where(F.col("source_id").isin(source_ids))
    who = politicians.join(
        listed.select(F.col("politician_id").alias("id")).distinct(), "id", "left_semi"
    )
    mine = facts.join(refs.select(F.col("property_id").alias("id")).distinct(), "id", "left_semi")
    return politician_documents(who, mine, entities, refs, sources, listed)


def fetch_ranked(ids: DataFrame, politicians: DataFrame, entities: DataFrame) -> DataFrame:
    """Live politicians of a ranked id list ``(wikidata_id, pos)``, in its order."""
    return (
        live_politicians(politicians, entities)
        .join(ids.groupBy("wikidata_id").agg(F.min("pos").alias("pos")), "wikidata_id")
        .orderBy("pos")
    )


# --- review layout --------------------------------------------------------------------------

# Order of the entity sections after the dates.
SECTION_ORDER = [POSITION, BIRTHPLACE, CITIZENSHIP]


def review_sections(facts: DataFrame) -> DataFrame:
    """Where each fact stands in the review form: section, rank of its group within the section,
    rank within the group. Most precise first, then chronological; undated last; groups by their
    first fact. Rows that tie are put in a fixed pseudo-random order, which also lets ranks of a
    politician with very many facts be computed in pieces.
    """
    is_date = F.col("type").isin(DATE_TYPES)
    section = F.when(is_date, 0)
    for i, t in enumerate(SECTION_ORDER, start=1):
        section = section.when(F.col("type") == t, i)
    rows = (
        D.with_qualifiers(live(facts), F.col("qualifiers_json"))
        .withColumn("section", section)
        .where(F.col("section").isNotNull())
        .withColumn("group_key", F.when(is_date, F.col("type")).otherwise(F.col("entity_id")))
        .withColumn("start", D.best_date(D.value_dates(F.col("P580")), latest=False))
        .withColumn(
            "at",
            F.when(is_date, D.imprecise(F.col("value"), F.col("value_precision")))
            .otherwise(F.col("start")),
        )
        .select(
            "politician_id", "section", "group_key", "id",
            F.coalesce(-F.col("at.precision"), F.lit(99)).alias("prec"),
            F.coalesce(D.date_key(F.col("at")), F.lit(0)).alias("key"),
            tie_break("id").alias("tie"),
        )
    )
    rows = written(rows, "review")  # qualifiers are parsed once
    counts = rows.groupBy("politician_id").agg(F.count(F.lit(1)).alias("n"))
    heavy = counts.where(F.col("n") > HEAVY).select("politician_id")
    if heavy.isEmpty():
        return _placed_together(rows)
    return _placed_together(rows.join(heavy, "politician_id", "left_anti")).unionByName(
        _placed_in_steps(rows.join(heavy, "politician_id", "left_semi"))
    )


#: Facts of a politician that are placed in one task; those of one with more are placed in steps.
HEAVY = 100_000
_PLACES = ["politician_id", "section", "group_rank", "group_key", "item_rank", "id"]


def _group_order() -> tuple[Column, Column]:
    """Dates keep birth before death whatever their values."""
    dates = F.col("section") == 0
    return (
        F.when(dates, 0).otherwise(F.col("prec")),
        F.when(dates, F.substring("group_key", 2, 9).try_cast("long")).otherwise(F.col("key")),
    )


def _placed_together(rows: DataFrame) -> DataFrame:
    """Both ranks over one shuffle by politician."""
    section = Window.partitionBy("politician_id", "section")
    group = Window.partitionBy("politician_id", "section", "group_key").orderBy("prec", "key", "tie", "id")
    prec, key = _group_order()
    first = F.first(F.struct(prec.alias("prec"), key.alias("key"))).over(group)
    ranked = rows.repartition("politician_id").select(
        "*", F.row_number().over(group).cast("long").alias("item_rank"), first.alias("first"),
        tie_break("group_key").alias("gtie"),
    )
    order = section.orderBy("first.prec", "first.key", "gtie", "group_key")
    return ranked.withColumn("group_rank", F.dense_rank().over(order).cast("long")).select(*_PLACES)


def _placed_in_steps(rows: DataFrame) -> DataFrame:
    """Both ranks without a whole politician in one task."""
    group = ["politician_id", "section", "group_key"]
    steps = {
        "prec": F.col("prec"), "year": F.floor(F.col("key") / 10000),
        "key": F.col("key"), "tie": F.substring("tie", 1, 2),
    }
    items = spread_rank(rows, group, steps, [F.col("tie"), F.col("id")], "item_rank")
    firsts = items.where(F.col("item_rank") == 1).withColumn("gtie", tie_break("group_key"))
    gsteps = {
        "prec": F.col("prec"), "year": F.floor(F.col("key") / 10000),
        "key": F.col("key"), "tie": F.substring("gtie", 1, 2),
    }
    prec, key = _group_order()
    placed = spread_rank(
        firsts.withColumns({"prec": prec, "key": key}),
        ["politician_id", "section"], gsteps, [F.col("gtie"), F.col("group_key")], "group_rank",
    ).select(*group, "group_rank")
    return items.join(placed, group).select(*_PLACES)


def initial_source(sections: DataFrame, facts: DataFrame, references: DataFrame) -> DataFrame:
    """The source each review starts with: that of the first fact (in review order) with a
    source and no statement. A minimum per politician, not a window."""
    first_ref = references.groupBy(F.col("property_id").alias("id")).agg(
        F.min(F.struct("source_id", "supporting_quotes")).alias("ref")
    )
    return (
        sections.join(facts.where(F.col("statement_id").isNull()).select("id"), "id", "left_semi")
        .join(first_ref, "id")
        .groupBy("politician_id")
        .agg(F.min(F.struct("section", "group_rank", "item_rank", "id", "ref")).alias("f"))
        .select("politician_id", F.col("f.id").alias("property_id"),
                F.col("f.ref.source_id").alias("source_id"),
                F.col("f.ref.supporting_quotes").alias("supporting_quotes"))
    )


def politician_context(
    politicians: DataFrame, facts: DataFrame, entities: DataFrame, types: list[str]
) -> DataFrame:
    """Known facts of a politician as texts per kind, as a language model is shown them (JSON).
    Soft-deleted facts are not left out here."""
    known = facts.where(F.col("type").isin(types))
    kind = F.when(F.col("type").isin(DATE_TYPES), "existing_wikidata")
    for t, k in [(POSITION, "existing_wikidata_positions"),
                 (BIRTHPLACE, "existing_wikidata_birthplaces"),
                 (CITIZENSHIP, "existing_wikidata_citizenships")]:
        kind = kind.when(F.col("type") == t, k)
    text = (
        F.when(F.col("type").isin(DATE_TYPES), F.concat_ws(": ", "type", "value"))
        .when(F.col("type") == POSITION,
              F.concat("entity_name", D.shown_timeframe(F.col("qualifiers_json"))))
        .otherwise(F.col("entity_name"))
    )
    lines = (
        _with_names(known, entities)
        .select("politician_id", F.inline(F.array(F.struct(kind.alias("kind"), text.alias("text")))))
        .where(F.col("text").isNotNull())
    )
    kinds = ["existing_wikidata", "existing_wikidata_positions",
             "existing_wikidata_birthplaces", "existing_wikidata_citizenships"]
    gathered = gather(lines, ["politician_id"], F.struct("kind", "text"), "lines")

    def texts(wanted: str) -> Column:
        return F.transform(F.filter("lines", lambda x: x["kind"] == wanted), lambda x: x["text"])

    of = {k: texts(k) for k in kinds}
    return (
        politicians.join(gathered.withColumnRenamed("politician_id", "id"), "id", "left")
        .select(
            "id",
            F.to_json(
                F.struct(
                    "name", "wikidata_id",
                    *[F.when(F.size(of[k]) > 0, of[k]).alias(k) for k in kinds],
                )
            ).alias("context"),
        )
    )


# --- filter form ----------------------------------------------------------------------------


#: Combining marks that are accents.
MARKS = "".join(map(chr, range(0x300, 0x370)))


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters that carry accents and what is left of them: each character whose canonical decomposition
    without accents is one other character, of all of Unicode."""
    carried, left = [], []
    for code in range(0xC0, 0x110000):
        letter = chr(code)
        if unicodedata.decomposition(letter) and letter not in MARKS:
            plain = "".join(c for c in unicodedata.normalize("NFD", letter) if c not in MARKS)
            if len(plain) == 1 and plain != letter:
                carried.append(letter)
                left.append(plain)
    return "".join(carried), "".join(left)


def plain_text(text: Column) -> Column:
    """Lower case without accents, whether a letter is stored with its accents or before them."""
    carried, left = _accents()
    return F.lower(F.translate(text, carried + MARKS, left))  # what has no counterpart is removed


def filter_options(
    options: DataFrame, query: str | None = None, chosen: list[str] | None = None, target: int = 6
) -> DataFrame:
    """Options ``(value, label, count)`` to show: those whose label contains the query, blind to
    case and accents, by count and label; without a query the chosen ones and the most counted
    others up to ``target``."""
    chosen = chosen or []
    if query:
        found = F.lower("label").contains(query.lower()) | plain_text(F.col("label")).contains(
            plain_text(F.lit(query))
        )
        return options.where(found).orderBy(F.desc("count"), "label", "value")
    mine = options.where(F.col("value").isin(chosen))
    others = options.where(~F.col("value").isin(chosen) & (F.col("count") > 0))
    slots = max(0, target - mine.count())  # a chosen value that is no option takes no slot
    return mine.unionByName(others.orderBy(F.desc("count"), "label", "value").limit(slots))


def match_locales(locales: DataFrame, languages: DataFrame) -> DataFrame:
    """Languages of browser locales ``(user_id, pos, locale)``: the part before ``-`` equal to a
    two- or three-letter code, the first match per locale, each language once per user at its
    first position."""
    codes = languages.select(
        "wikidata_id", F.explode(F.array(F.lower("iso_639_1"), F.lower("iso_639_3"))).alias("code")
    ).where(F.col("code").isNotNull()).groupBy("code").agg(F.min("wikidata_id").alias("wikidata_id"))
    code = F.lower(F.get(F.split("locale", "-"), F.lit(0)))
    return (
        locales.select("user_id", "pos", code.alias("code")).join(codes, "code")
        .groupBy("user_id", "wikidata_id").agg(F.min("pos").alias("pos"))
    )
