"""Reconciling extracted facts with known ones.

Facts have (id, politician_id, type, value, value_precision, entity_id, qualifiers_json,
created_at); candidates have the same value columns plus (cand_id, source_id, seq,
supporting_quotes). Imprecise dates are matched through the equality keys of
:mod:`kbcurate.functions.dates`, so no step compares all pairs of a block.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from kbcurate.functions import dates as D
from kbcurate.schemas import BIRTHPLACE, CITIZENSHIP, DATE_TYPES, POSITION
from kbcurate.session import discard, shuffled, written, written_once

NO_MATCH, SELF_FINER, OTHER_FINER, EQUAL = (
    "NO_MATCH", "SELF_MORE_PRECISE", "OTHER_MORE_PRECISE", "EQUAL",
)
BLOCK = ["politician_id", "type", "place"]


# --- pairwise comparison --------------------------------------------------------------------


def placed(df: DataFrame) -> DataFrame:
    """Adds ``place`` (the entity, for facts that need one), of which no text is parsed."""
    is_date = F.col("type").isin(DATE_TYPES)
    return df.withColumn("place", F.when(is_date, F.lit("")).otherwise(F.coalesce("entity_id", F.lit(""))))


def fact_view(df: DataFrame) -> DataFrame:
    """Adds ``date``, ``start``, ``end`` and ``place``."""
    is_date = F.col("type").isin(DATE_TYPES)
    terms = F.when(F.col("type") == POSITION, F.col("qualifiers_json"))
    return (
        D.with_qualifiers(placed(df), terms)
        .withColumns({
            "date": F.when(is_date, D.imprecise(F.col("value"), F.col("value_precision"))),
            "start": D.first_date("P580"),
            "end": D.first_date("P582"),
        })
        .drop("P580", "P582")
    )


def _verdict(self_finer: Column, other_finer: Column) -> Column:
    return (
        F.when(self_finer & ~other_finer, SELF_FINER)
        .when(other_finer & ~self_finer, OTHER_FINER)
        .otherwise(EQUAL)
    )


def compare_facts(a: Column, b: Column) -> Column:
    """How fact ``a`` relates to fact ``b``; both are structs of a :func:`fact_view` row."""
    by_date = F.when(~D.could_be_same(a["date"], b["date"]), NO_MATCH).otherwise(
        _verdict(D.finer(a["date"], b["date"]), D.finer(b["date"], a["date"]))
    )
    a_dated = a["start"].isNotNull() | a["end"].isNotNull()
    b_dated = b["start"].isNotNull() | b["end"].isNotNull()
    same_frame = D.could_be_same(a["start"], b["start"]) & D.could_be_same(a["end"], b["end"])
    by_frame = (
        F.when(a_dated & ~b_dated, SELF_FINER)
        .when(b_dated & ~a_dated, OTHER_FINER)
        .when(~same_frame, NO_MATCH)
        .otherwise(
            _verdict(
                D.finer(a["start"], b["start"]) | D.finer(a["end"], b["end"]),
                D.finer(b["start"], a["start"]) | D.finer(b["end"], a["end"]),
            )
        )
    )
    same_entity = a["entity_id"].eqNullSafe(b["entity_id"])
    return (
        F.when(~a["type"].eqNullSafe(b["type"]), NO_MATCH)
        .when(a["type"].isin(DATE_TYPES), by_date)
        .when(~same_entity, NO_MATCH)
        .when(a["type"] == POSITION, by_frame)
        .otherwise(EQUAL)
    )


# --- matching through keys ------------------------------------------------------------------


def _same_or_finer(d: str) -> Column:
    """Keys under which a date is found by an equal or coarser one."""
    return F.concat(F.array(D.own_key(d)), D.ancestor_keys(d))


def _same_or_coarser(d: str) -> Column:
    """Keys with which a date looks for equal or finer ones."""
    return F.concat(F.array(D.own_key(d)), D.container_keys(d))


def value_key() -> Column:
    """Everything about a value that matching can see; copies share it."""
    return F.concat_ws(
        "|", D.own_key("date"), D.own_key("start"), D.own_key("end")
    )


def _start_levels(view: DataFrame) -> list[int]:
    """Precisions that starts of terms have: a handful, whatever the rows."""
    rows = view.where(_is_term()).select(F.col("start.precision").alias("p")).where("p IS NOT NULL").distinct().collect()
    return sorted(r.p for r in rows)


def _start_bins(
    view: DataFrame, keep: list[str], stored: bool, coarser_too: bool = True, others: list[int] | None = None
) -> DataFrame:
    """Rows of ``view`` under the bins of their start: two terms whose starts may name the same time
    meet in one. Terms on file lie in their own bin and those of coarser dates (``a``), candidates look
    in their own and in those of finer ones; with ``coarser_too`` also the other way around (``b``).
    Bins that no start of the ``others``' precisions (see :func:`_start_levels`) can share are left out."""
    up, down = D.ancestor_keys("start"), D.container_keys("start")
    if others is not None:
        up = F.filter(up, lambda k: F.regexp_extract(k, "^<([0-9]+)", 1).isin([str(p) for p in others]))
        down = F.when(F.col("start.precision") < max(others, default=0), down).otherwise(F.array().cast("array<string>"))
    near, far = (up, down) if stored else (down, up)
    bins = F.transform(F.concat(F.array(D.own_key("start")), near), lambda k: F.concat(F.lit("a"), k))
    if coarser_too:
        bins = F.concat(bins, F.transform(far, lambda k: F.concat(F.lit("b"), k)))
    return view.select(*keep, F.explode(bins).alias("key"))


def _match_keys(view: DataFrame, keep: list[str], stored: bool) -> DataFrame:
    """Rows of ``view`` under their match keys, office terms left out.

    Known facts (``stored``) are filed as they are and as the finer one; candidates look as they
    are and as the coarser one. An undated candidate term, a birthplace or a citizenship only asks
    for anything in its block.
    """
    side = _same_or_finer if stored else _same_or_coarser
    is_date = F.col("type").isin(DATE_TYPES)
    dates = view.where(is_date).select(*keep, F.explode(side("date")).alias("key"))
    whole = view.where(~is_date if stored else ~is_date & ~_is_term()).select(*keep, F.lit("any").alias("key"))
    return dates.unionByName(whole)


def _is_term() -> Column:
    return (F.col("type") == POSITION) & (F.col("start").isNotNull() | F.col("end").isNotNull())


def _candidate_values(view: DataFrame) -> DataFrame:
    """Distinct values per block: copies of a candidate are looked up once."""
    return view.withColumn("vkey", value_key()).groupBy(*BLOCK, "vkey").agg(
        F.first("date").alias("date"), F.first("start").alias("start"), F.first("end").alias("end")
    )


def _in_blocks(facts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Live facts of the blocks that candidates ask for; nothing of either is parsed."""
    live = placed(facts.where(F.col("deleted_at").isNull()))
    return live.join(shuffled(placed(candidates).select(*BLOCK).distinct()), BLOCK, "left_semi")


def match_facts(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """(cand_id, fact_id): the first live fact, by creation time and id, that equals a candidate
    or is more precise than it.

    Facts are cut to the candidates' blocks before their dates are parsed. Candidates with their parsed
    dates are written first, then distinct values of both, as each is read several times. Office terms meet in bins of
    their start, and their ends and precisions are compared there; pairs are made only of
    distinct terms of one politician, office and bin.
    """
    view = fact_view(candidates).select("cand_id", "entity_id", *BLOCK, "date", "start", "end")
    cands = written(view, "candidates").withColumn("vkey", value_key())
    found, _ = _matched_values(cands, facts)
    return cands.join(shuffled(found), [*BLOCK, "vkey"]).select("cand_id", F.col("fact.id").alias("fact_id"))


def _matched_values(cands: DataFrame, facts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The fact of each distinct value of parsed candidates that has one, and the tables written for it."""
    values = written_once(_candidate_values(cands), "values")
    stored = fact_view(_in_blocks(facts, cands)).withColumn("vkey", value_key())
    filed = written_once(
        stored.groupBy(*BLOCK, "vkey").agg(
            F.first("date").alias("date"), F.first("start").alias("start"), F.first("end").alias("end"),
            F.min(F.struct("created_at", "id")).alias("fact"),
        ), "filed",
    )
    index = (
        _match_keys(filed, [*BLOCK, "fact"], stored=True)
        .groupBy(*BLOCK, "key").agg(F.min("fact").alias("fact"))
    )
    plain = _match_keys(values, [*BLOCK, "vkey"], stored=False).join(shuffled(index), [*BLOCK, "key"]).select(*BLOCK, "vkey", "fact")
    levels = [_start_levels(view) for view in (values, filed)]
    theirs = _start_bins(filed.where(_is_term()), [*BLOCK, "fact", "start", "end"], stored=True, others=levels[0])
    ours = _start_bins(
        values.where(_is_term()), [*BLOCK, "vkey", F.col("start").alias("s"), F.col("end").alias("e")],
        stored=False, others=levels[1],
    )
    start, end, s, e = F.col("start"), F.col("end"), F.col("s"), F.col("e")
    finer = (D.finer(s, start) | D.finer(e, end)) & ~(D.finer(start, s) | D.finer(end, e))
    terms = ours.join(shuffled(theirs), [*BLOCK, "key"]).where(
        D.could_be_same(s, start) & D.could_be_same(e, end) & ~finer
    ).select(*BLOCK, "vkey", "fact")
    found = plain.unionByName(terms).groupBy(*BLOCK, "vkey").agg(F.min("fact").alias("fact"))
    return found, [values, filed]


# --- subsumption by consecutive terms -------------------------------------------------------


# Order of the terms of an office: by start, then an open end first, then by end.
TERM_ORDER = ["skey", "sprec", "eprec", "ekey"]


def _distinct_terms(view: DataFrame) -> DataFrame:
    none = F.lit(-1)
    return (
        view.withColumn("skey", F.coalesce(D.date_key(F.col("start")), none))
        .withColumn("sprec", F.coalesce("start.precision", none))
        .withColumn("eprec", F.coalesce("end.precision", none))
        .withColumn("ekey", F.coalesce(D.date_key(F.col("end")), none))
        .groupBy("politician_id", "place", *TERM_ORDER)
        .agg(F.min("start").alias("start"), F.min("end").alias("end"),
             F.count(F.lit(1)).alias("copies"))
    )


def _office_terms(facts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Live dated terms of the given offices, one row per distinct term with its number of copies."""
    view = placed(facts.where((F.col("type") == POSITION) & F.col("deleted_at").isNull())).join(
        blocks, ["politician_id", "place"], "left_semi"
    )
    return _distinct_terms(fact_view(view).where(F.col("start").isNotNull()))


def chain_ends(terms: DataFrame) -> DataFrame:
    """Each term with the end of the run of consecutive terms it belongs to, whether it starts one
    (``gap``), and how many copies of it the row stands for (``weight``).

    Gaps and islands over terms in start order. An office with very many terms is not put into
    one task: terms are linked within a start year, and years are stitched by their edges, of
    which there are as many as years. Of equal terms the first links to what is before and the last to
    what follows; all between them are alike and one row.
    """
    office = ["politician_id", "place"]
    order = F.struct(*TERM_ORDER, "copy")
    in_year = Window.partitionBy(*office, "y").orderBy(*TERM_ORDER, "copy")
    years = Window.partitionBy(*office).orderBy("y")
    rows = terms.select(
        *office, *TERM_ORDER, "start", "end", D.year(F.col("start")).alias("y"),
        "copies", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(3)).cast("int"))).alias("copy"),
    ).where(F.col("y").isNotNull()).withColumn(
        "weight", F.when((F.col("copy") == 2) & (F.col("copies") > 3), F.col("copies") - 2).otherwise(1)
    )
    edges = (
        rows.groupBy(*office, "y").agg(F.max_by("end", order).alias("last_end"))
        .select(*office, "y", F.lag("last_end").over(years).alias("carried"))
    )
    linked = (
        rows.withColumn("n", F.row_number().over(in_year))
        .withColumn("before", F.lag("end").over(in_year))
        .join(edges, [*office, "y"])
        .withColumn("before", F.when(F.col("n") == 1, F.col("carried")).otherwise(F.col("before")))
        .withColumn(
            "gap",
            (F.col("before").isNull() | ~D.consecutive(F.col("before"), F.col("start"))).cast("int"),
        )
        .withColumn("local", F.sum("gap").over(in_year.rowsBetween(Window.unboundedPreceding, 0)))
    )
    earlier = years.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        linked.groupBy(*office, "y").agg(F.sum("gap").alias("gaps"))
        .select(*office, "y", F.coalesce(F.sum("gaps").over(earlier), F.lit(0)).alias("offset"))
    )
    islands = linked.join(offsets, [*office, "y"]).withColumn(
        "island", F.col("local") + F.col("offset")
    )
    ends = islands.groupBy(*office, "island").agg(F.max_by("end", order).alias("chain_end"))
    return islands.join(ends, [*office, "island"]).select(
        *office, "skey", "start", "end", "gap", "weight", "chain_end"
    )


def subsumed(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """cand_ids of office terms that two or more known terms of the office already tell: the
    candidate starts with one of them, is not finer, and ends where its run of consecutive terms
    ends (or both are open)."""
    office = ["politician_id", "place"]
    cands = (
        fact_view(candidates.where(F.col("type") == POSITION))
        .where(F.col("start").isNotNull() & (F.col("place") != ""))
        .withColumn("vkey", value_key())
    )
    values = written(_candidate_values(cands), "values")
    mine = facts.where((F.col("type") == POSITION) & F.col("deleted_at").isNull())
    many = (
        mine.groupBy("politician_id", F.col("entity_id").alias("place"))
        .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    )
    blocks = values.select(*office).distinct().join(many, office, "left_semi")
    chains = chain_ends(written(_office_terms(facts, blocks), "terms"))
    offered = written(chains.select(*office, "start", "chain_end").distinct(), "offered")
    theirs = _start_bins(offered, [*office, "chain_end"], stored=True, coarser_too=False)
    ours = _start_bins(values, [*office, "vkey", "end"], stored=False, coarser_too=False)
    end, told = F.col("end"), F.col("chain_end")
    same = [ours[c] == theirs[c] for c in [*office, "key"]]
    hit = (
        ours.join(theirs, [*same, D.could_be_same(end, told) & ~D.finer(end, told)], "left_semi")
        .select(*office, "vkey").distinct()
    )
    return cands.join(hit, [*office, "vkey"], "left_semi").select("cand_id")


# --- candidates -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Candidates:
    valid: DataFrame
    rejected: DataFrame


_DATE_TEXT = r"^\d{4}(-\d{2}){0,2}$"


def candidate_id() -> Column:
    return F.sha2(
        F.concat_ws("|", F.lit("candidate"), "politician_id", "source_id", F.col("seq").cast("string")),
        256,
    )


def candidate_rows(extractions: DataFrame) -> Candidates:
    """Candidate facts of extraction results: dates parsed, office terms given qualifiers. Rows
    with a malformed date are kept aside."""

    def bad(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.col(c).rlike(_DATE_TEXT)

    is_date = F.col("kind").isin(DATE_TYPES)
    is_term = F.col("kind") == POSITION
    wrong = F.when(is_date, F.col("value").isNull() | bad("value")).when(
        is_term, bad("start_date") | bad("end_date")
    ).otherwise(F.lit(False))
    rows = extractions.withColumn("_wrong", wrong)
    texts = {"_date": ("value", is_date), "_start": ("start_date", is_term), "_end": ("end_date", is_term)}
    valid = (
        rows.where(~F.col("_wrong"))
        .withColumns({n: F.when(cond, D.text_time(F.col(c))) for n, (c, cond) in texts.items()})
        .withColumns({
            n[1:]: D.imprecise(F.col(n), D.text_precision(F.col(c))) for n, (c, _) in texts.items()
        })
        .select(
            candidate_id().alias("cand_id"), "politician_id", "source_id", "seq",
            F.col("kind").alias("type"),
            F.col("date.time").alias("value"), F.col("date.precision").alias("value_precision"),
            F.when(~is_date, F.col("entity_id")).alias("entity_id"),
            D.term_qualifiers(F.col("start"), F.col("end")).alias("qualifiers_json"),
            "supporting_quotes",
        )
    )
    return Candidates(valid, rows.where("_wrong").drop("_wrong"))


def extraction_counts(extractions: DataFrame) -> DataFrame:
    """Extracted items per source over all kinds."""
    return extractions.groupBy("source_id").agg(F.count(F.lit(1)).alias("items"))


def invalid_facts(facts: DataFrame) -> DataFrame:
    """Facts that break the table rule: dates have value and precision and no entity, entity
    facts have an entity and no value."""
    is_date = F.col("type").isin(DATE_TYPES)
    value, precision, entity = (F.col(c).isNotNull() for c in ("value", "value_precision", "entity_id"))
    fine = F.when(is_date, value & precision & ~entity).when(
        F.col("type").isin(BIRTHPLACE, POSITION, CITIZENSHIP), entity & ~value
    ).otherwise(F.lit(False))
    return facts.where(~fine)


def invalid_sources(sources: DataFrame) -> DataFrame:
    """Sources whose HTTP code and fetch error do not come together."""
    fetch_error = F.coalesce(F.col("error") == "FETCH_ERROR", F.lit(False))
    return sources.where(fetch_error != F.col("http_status_code").isNotNull())


def merge_references(references: DataFrame, new: DataFrame) -> DataFrame:
    """One row per fact and source; its quotes are the sorted set of all quotes given.

    Repeated quotes are dropped before they are gathered, so a group holds a source's distinct
    quotes of one fact, however many copies came in.
    """
    keys = ["property_id", "source_id"]
    rows = references.select(*keys, "supporting_quotes").unionByName(
        new.select(*keys, "supporting_quotes")
    )
    quotes = rows.select(*keys, F.explode_outer("supporting_quotes").alias("quote")).distinct()
    return quotes.groupBy(*keys).agg(
        F.array_sort(F.collect_list("quote")).alias("supporting_quotes")
    )


# --- merging extractions --------------------------------------------------------------------


@dataclass(frozen=True)
class Merge:
    """``assigned(cand_id, property_id)``, facts to add, references after the merge, and the
    candidates dropped because known terms already tell them."""

    assigned: DataFrame
    new_facts: DataFrame
    references: DataFrame
    dropped: DataFrame


def new_fact_id(cand_id: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("fact"), cand_id), 256)


def _first_claims(rest: DataFrame) -> DataFrame:
    """Owners of unmatched candidates without terms: (cand_id, owner).

    Candidate dates have year, month or day precision, so they form a tree, and processing them
    in order makes exactly those values new facts that precede everything equal or finer; all
    others refer to the earliest equal or finer one. Both are one minimum over a value's subtree.
    Places have one value per block and the same rule.
    """
    cands = rest.withColumn("vkey", value_key())
    values = cands.groupBy(*BLOCK, "vkey").agg(
        F.first("date").alias("date"), F.min(F.struct("seq", "cand_id")).alias("first")
    )
    subtree = (
        values.select(*BLOCK, F.explode(_same_or_finer("date")).alias("key"), "first")
        .groupBy(*BLOCK, "key").agg(F.min("first").alias("first"))
    )
    owners = (
        values.select(*BLOCK, "vkey", F.explode(_same_or_coarser("date")).alias("key"))
        .join(shuffled(subtree), [*BLOCK, "key"])
        .groupBy(*BLOCK, "vkey").agg(F.min("first").alias("owner"))
    )
    return cands.join(shuffled(owners), [*BLOCK, "vkey"]).select(
        "cand_id", F.col("owner.cand_id").alias("owner")
    )


_OUTCOME = (
    "politician_id string, place string, vkey string, outcome string, seq long, owner string"
)


def _parts(prefix: str, d: Column) -> list[Column]:
    return [
        d["precision"].alias(f"{prefix}p"), D.year(d).alias(f"{prefix}y"),
        F.coalesce(D.month(d), F.lit(0)).alias(f"{prefix}m"),
        F.coalesce(D.day(d), F.lit(0)).alias(f"{prefix}d"),
    ]


def _date_of(row, prefix: str):
    p = getattr(row, f"{prefix}p")
    if pd.isna(p):
        return None
    return tuple(int(getattr(row, f"{prefix}{c}")) for c in "pymd")


def _falls_in(coarse, fine) -> bool:
    """``fine`` equals ``coarse`` or is a finer date within it (None only equals None)."""
    if coarse is None or fine is None:
        return coarse is fine
    cp, cy, cm, cd = coarse
    fp, fy, fm, fd = fine
    if cp > fp:
        return False
    if cp == fp and cp <= D.YEAR or cp == D.YEAR:
        return cy == fy
    if cp == D.MILLENNIUM:
        return (cy - 1) // 1000 == (fy - 1) // 1000
    if cp == D.CENTURY:
        return cy <= fy <= cy + 99
    if cp == D.DECADE:
        return cy // 10 == fy // 10
    if cp == D.MONTH:
        return (cy, cm) == (fy, fm)
    if cp == D.DAY or cp == fp:
        return (cy, cm, cd) == (fy, fm, fd)
    return False


def _adjoin(end, start) -> bool:
    if end is None or end[0] != start[0] or end[0] not in (D.YEAR, D.MONTH, D.DAY):
        return False
    (p, ey, em, ed), (_, sy, sm, sd) = end, start
    if p == D.YEAR:
        gap = sy - ey
    elif p == D.MONTH:
        gap = (sy - ey) * 12 + sm - em if sm and em else -1
    else:
        try:
            gap = (pd.Timestamp(sy, sm, sd) - pd.Timestamp(ey, em, ed)).days
        except ValueError:
            return False
    return 0 <= gap <= 1


def _term_matches(cand, known) -> bool:
    """The known term equals the candidate or is more precise than it."""
    if cand == (None, None):
        return True
    if known == (None, None):
        return False
    up = [_falls_in(c, k) for c, k in zip(cand, known)]
    down = [_falls_in(k, c) for c, k in zip(cand, known)]
    if not all(u or d for u, d in zip(up, down)):
        return False
    finer_candidate = any(not u for u in up)
    finer_known = any(not d for d in down)
    return finer_known or not finer_candidate


def _told_by(cand, terms) -> bool:
    """Some run of consecutive terms (in start order) spans the candidate."""
    start, end = cand
    if start is None:
        return False
    for i, (_, first, chain_end) in enumerate(terms):
        if not _falls_in(start, first):
            continue
        for _, nxt, nxt_end in terms[i + 1:]:
            if not _adjoin(chain_end, nxt):
                break
            chain_end = nxt_end
        if _falls_in(end, chain_end):
            return True
    return False


def _order(term) -> tuple:
    (start, end) = term
    return (start[1:], start[0], end is not None, end or ())


#: First copies of a term that its office has at hand.
COPIES = 1_000


_OUTCOME_COLUMNS = ["politician_id", "place", "vkey", "outcome", "seq", "owner"]
#: Outcome rows that are handed back at once.
OUTCOMES = 10_000


def _outcome_frame(out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=_OUTCOME_COLUMNS)
    frame["seq"] = frame["seq"].astype("Int64")
    return frame


def _settle_offices(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Outcomes of offices whose rows follow each other, over batches too. There are as many offices as
    holders and most have few terms, so a frame per office would cost more than its replay."""
    rows = (r for part in parts for r in part.itertuples(index=False))
    out: list[tuple] = []
    for block, mine in groupby(rows, key=lambda r: (r.politician_id, r.place)):
        out.extend(_settle_office(block, mine))
        if len(out) >= OUTCOMES:
            yield _outcome_frame(out)
            out = []
    if out:
        yield _outcome_frame(out)


def _settle_office(block: tuple, rows: Iterable) -> list[tuple]:
    """Replay one office's distinct unmatched terms in order of first appearance.

    A dropped term may match or stand on its own once a later fact changed the state; only its next
    copy can tell, which is looked up in the sorted list of the term's first copies. Where that list
    ends and there are more, a ``next`` row is asked for (outcome ``ask``) and the office replayed with
    it. Input is bounded by ``COPIES`` times the distinct timeframes, whatever the candidates.
    """
    terms, known, events, values, followers, later = [], 0, [], {}, {}, {}
    for r in rows:
        if r.kind == "term":
            known += int(r.copies)
            start = _date_of(r, "s")
            if start is not None:
                term = (start, _date_of(r, "e"))
                for _ in range(min(int(r.copies), 2)):
                    terms.append((_order(term), *term))
        elif r.kind == "value":
            values[r.vkey] = (_date_of(r, "s"), _date_of(r, "e"))
            heapq.heappush(events, (int(r.seq), r.cand_id, r.vkey))
            later[r.vkey] = list(r.seqs), list(r.cand_ids), bool(r.more)
        else:
            followers[(r.vkey, int(r.after))] = None if pd.isna(r.seq) else (int(r.seq), r.cand_id)
    terms.sort()
    created, waiting, out = [], set(), []

    def copy_after(vkey: str, seq: int):
        """(known, next copy or None) of a term after ``seq``."""
        if (vkey, seq) in followers:
            return True, followers[(vkey, seq)]
        seqs, ids, more = later[vkey]
        at = bisect.bisect_right(seqs, seq)
        if at < len(seqs):
            return True, (int(seqs[at]), ids[at])
        return not more, None

    while events:
        seq, cand_id, vkey = heapq.heappop(events)
        cand = values[vkey]
        owner = next((c for c, t in created if _term_matches(cand, t)), None)
        if owner is not None:
            out.append((*block, vkey, "match", seq, owner))
            continue
        if known >= 2 and _told_by(cand, terms):
            waiting.add(vkey)
            continue
        out.append((*block, vkey, "new", seq, cand_id))
        created.append((cand_id, cand))
        known += 1
        if cand[0] is not None:
            bisect.insort(terms, (_order(cand), *cand))
        for w in sorted(waiting):
            if _term_matches(values[w], cand) or not _told_by(values[w], terms):
                told, nxt = copy_after(w, seq)
                if not told:
                    return [(*block, w, "ask", seq, None)]
                waiting.discard(w)
                if nxt is not None:
                    heapq.heappush(events, (*nxt, w))
                else:
                    out.append((*block, w, "dropped", None, None))
    out.extend((*block, w, "dropped", None, None) for w in sorted(waiting))
    return out


def _settle_terms(rest: DataFrame, facts: DataFrame) -> DataFrame:
    """Outcome per distinct unmatched office term: (politician_id, place, vkey, outcome, seq,
    owner). Copies from ``seq`` on refer to the fact of candidate ``owner``; earlier copies, and
    all of a dropped term, are dropped."""
    office = ["politician_id", "place"]
    values = written_once(
        rest.groupBy(*office, "vkey")
        .agg(F.min(F.struct("seq", "cand_id")).alias("first"), F.count(F.lit(1)).alias("times"),
             F.first("start").alias("start"), F.first("end").alias("end")), "asked",
    )
    blocks = values.groupBy(*office).agg(F.count(F.lit(1)).alias("distinct_terms"))
    live = placed(facts.where((F.col("type") == POSITION) & F.col("deleted_at").isNull()))
    stored = (
        live.select(*office).join(shuffled(blocks.select(*office)), office, "left_semi")
        .groupBy(*office).agg(F.count(F.lit(1)).alias("known"))
    )
    # a single distinct term of an office with fewer than two known terms is simply new
    simple = (F.col("distinct_terms") == 1) & (F.coalesce("known", F.lit(0)) < 2)
    offices = written_once(
        blocks.join(shuffled(stored), office, "left").select(*office, simple.alias("simple")), "offices"
    )
    plain = values.join(shuffled(offices.where("simple")), office, "left_semi").select(
        *office, "vkey", F.lit("new").alias("outcome"),
        F.col("first.seq").cast("long").alias("seq"), F.col("first.cand_id").alias("owner"),
    )
    hard = shuffled(offices.where("NOT simple").select(*office))
    open_values = values.join(hard, office, "left_semi")
    copies = Window.partitionBy(*office, "vkey").orderBy("seq", "cand_id")  # limited before the shuffle
    lists = (
        rest.join(shuffled(open_values.where("times > 1").select(*office, "vkey")), [*office, "vkey"], "left_semi")
        .withColumn("n", F.row_number().over(copies)).where(F.col("n") <= COPIES + 1)
        .groupBy(*office, "vkey").agg(F.array_sort(F.collect_list(F.struct("seq", "cand_id"))).alias("first_copies"))
        .select(*office, "vkey", F.slice("first_copies", 1, COPIES).alias("c"), (F.size("first_copies") > COPIES).alias("more"))
    )
    null_long, null_text = F.lit(None).cast("long"), F.lit(None).cast("string")

    no_seqs, no_ids = F.array().cast("array<long>"), F.array().cast("array<string>")

    def shaped(df: DataFrame, kind: str, vkey, seq, after, copies, cand_id, seqs=no_seqs, ids=no_ids, more=F.lit(False)) -> DataFrame:
        return df.select(
            *office, F.lit(kind).alias("kind"), vkey.alias("vkey"), seq.cast("long").alias("seq"),
            after.cast("long").alias("after"), *_parts("s", F.col("start")),
            *_parts("e", F.col("end")), copies.cast("long").alias("copies"),
            cand_id.alias("cand_id"), seqs.alias("seqs"), ids.alias("cand_ids"), more.alias("more"),
        )

    terms = _distinct_terms(fact_view(live.join(hard, office, "left_semi")))
    listed = F.coalesce("c", F.array("first"))  # a value that stands once is its own list
    rows = shaped(terms, "term", null_text, null_long, null_long, F.col("copies"), null_text).union(
        shaped(
            open_values.join(shuffled(lists), [*office, "vkey"], "left"), "value", F.col("vkey"), F.col("first.seq"),
            null_long, null_long, F.col("first.cand_id"), listed["seq"].cast("array<long>"), listed["cand_id"],
            F.coalesce("more", F.lit(False)),
        )
    )
    rows = written_once(rows, "terms")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = None
    while True:
        together = rows.repartition(tasks, *office).sortWithinPartitions(*office)
        outcome = written_once(together.mapInPandas(_settle_offices, _OUTCOME), "settled")
        questions = outcome.where(F.col("outcome") == "ask")
        if questions.isEmpty():
            return plain.unionByName(outcome)
        asks = questions.select(*office, "vkey", F.col("seq").alias("after"))
        asked = asks if asked is None else asked.union(asks)
        nxt = (
            asked.join(shuffled(rest.select(*office, "vkey", "seq", "cand_id")), [*office, "vkey"], "left")
            .groupBy(*office, "vkey", "after")
            .agg(F.min(F.when(F.col("seq") > F.col("after"), F.struct("seq", "cand_id"))).alias("n"))
            .withColumn("start", D.no_date()).withColumn("end", D.no_date())
        )
        base = rows.where(F.col("kind") != "next")
        rows = written(
            base.union(
                shaped(nxt, "next", F.col("vkey"), F.col("n.seq"), F.col("after"), null_long,
                       F.col("n.cand_id"))
            ),
            "terms",
        )


def merge_extractions(facts: DataFrame, references: DataFrame, candidates: DataFrame) -> Merge:
    """Merge candidates into known facts, in ``seq`` order within a politician: a match adds a
    reference only, a told office term is dropped, anything else becomes a new fact - which
    counts for the candidates after it.

    Known facts come before new ones, so matching them first settles most candidates in one
    join. The order only matters among the rest: dates and places have a closed form
    (:func:`_first_claims`), office terms are replayed per office on their distinct timeframes.
    Candidates are written with their parsed dates, then once more with the fact they match or else what the rest needs
    of them; tables and shuffle files of a finished step are removed.
    """
    candidates = written_once(fact_view(candidates), "candidates")
    cands = candidates.withColumn("vkey", value_key())
    found, used = _matched_values(cands, facts)
    matched = F.col("fact").isNotNull()
    judged = written_once(
        cands.join(shuffled(found), [*BLOCK, "vkey"], "left").select(
            "cand_id", matched.alias("matched"), F.col("fact.id").alias("fact_id"),
            *[F.when(~matched, F.col(c)).alias(c) for c in ("seq", *BLOCK, "vkey", "date", "start", "end")],
        ), "judged",
    )
    discard(*used)
    rest = judged.where("NOT matched")
    simple = _first_claims(rest.where(F.col("type") != POSITION).drop("vkey"))
    positions = rest.where(F.col("type") == POSITION)
    settled = _settle_terms(positions, facts)
    placed = positions.join(
        shuffled(settled.withColumnRenamed("seq", "from_seq")), ["politician_id", "place", "vkey"]
    )
    kept = F.col("owner").isNotNull() & (F.col("seq") >= F.col("from_seq"))
    placed = written_once(placed.select("cand_id", F.when(kept, F.col("owner")).alias("owner")), "placed")
    owned = simple.unionByName(placed.where("owner IS NOT NULL"))
    assigned = judged.where("matched").select("cand_id", F.col("fact_id").alias("property_id")).unionByName(
        owned.select("cand_id", new_fact_id(F.col("owner")).alias("property_id"))
    )
    founders = owned.where(F.col("cand_id") == F.col("owner"))
    new_facts = candidates.join(shuffled(founders), "cand_id", "left_semi").select(
        new_fact_id(F.col("cand_id")).alias("id"), "politician_id", "type", "value",
        "value_precision", "entity_id", "qualifiers_json",
        F.lit(None).cast("string").alias("statement_id"),
    )
    new_refs = candidates.join(shuffled(assigned), "cand_id").select(
        "property_id", "source_id", "supporting_quotes"
    )
    dropped = placed.where("owner IS NULL").select("cand_id")
    return Merge(assigned, new_facts, merge_references(references, new_refs), dropped)
