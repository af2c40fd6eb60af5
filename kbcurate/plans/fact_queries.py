"""Queries on imprecise dates and on reconciling facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kbcurate.functions import dates as D
from kbcurate.operators import facts as R, pages as P
from kbcurate.plans.registry import as_of, query
from kbcurate.plans.views import Catalog, date_text, pad
from kbcurate.session import written

# --- dates, as SQL over part columns (p, y, m, d) -------------------------------------------


def _cols(names: str) -> tuple[str, ...]:
    return tuple(names.split())


A, B = _cols("ap ay am ad"), _cols("bp bq bm bd")


def same_sql(a, b) -> str:
    """Could be the same time; missing months and days are 0."""
    (ap, ay, am, ad), (bp, by, bm, bd) = a, b
    day = f"{ay} = {by} AND {am} = {bm} AND {ad} = {bd}"
    month = f"{ay} = {by} AND {am} = {bm}"
    cy, fy = f"(CASE WHEN {ap} < {bp} THEN {ay} ELSE {by} END)", f"(CASE WHEN {ap} < {bp} THEN {by} ELSE {ay} END)"
    low = f"least({ap}, {bp})"
    return f"""(CASE WHEN {ap} IS NULL AND {bp} IS NULL THEN true
        WHEN {ap} IS NULL OR {bp} IS NULL THEN false
        WHEN {ap} = {bp} THEN CASE WHEN {ap} <= 9 THEN {ay} = {by} WHEN {ap} = 10 THEN {month} ELSE {day} END
        WHEN {low} = 6 THEN {fy} BETWEEN floor(({cy} - 1) / 1000.0) * 1000 + 1 AND floor(({cy} - 1) / 1000.0) * 1000 + 1000
        WHEN {low} = 7 THEN {fy} BETWEEN {cy} AND {cy} + 99
        WHEN {low} = 8 THEN {fy} BETWEEN floor({cy} / 10.0) * 10 AND floor({cy} / 10.0) * 10 + 9
        WHEN {low} = 9 THEN {ay} = {by} WHEN {low} = 10 THEN {month} WHEN {low} = 11 THEN {day}
        ELSE false END)"""


def finer_sql(a, b) -> str:
    return f"({a[0]} IS NOT NULL AND coalesce({a[0]} > {b[0]}, true))"


def adjoin_sql(e, s) -> str:
    (ep, ey, em, ed), (sp, sy, sm, sd) = e, s
    def date(y, m, d):
        return f"try_cast({pad(y, 4)} || '-' || {pad(m, 2)} || '-' || {pad(d, 2)} AS DATE)"
    return f"""coalesce(CASE WHEN {ep} IS NULL OR {sp} IS NULL OR {ep} <> {sp} THEN false
        WHEN {ep} = 9 THEN {sy} - {ey} BETWEEN 0 AND 1
        WHEN {ep} = 10 AND {sm} > 0 AND {em} > 0 THEN ({sy} - {ey}) * 12 + {sm} - {em} BETWEEN 0 AND 1
        WHEN {ep} = 11 AND {sd} > 0 AND {ed} > 0
            THEN {date(sy, sm, sd)} - {date(ey, em, ed)} BETWEEN 0 AND 1
        ELSE false END, false)"""


def display_sql(d) -> str:
    p, y, m, dd = d
    return f"""CASE WHEN {p} IS NULL THEN NULL
        WHEN {p} >= 11 AND {m} > 0 AND {dd} > 0 THEN {pad(y, 4)} || '-' || {pad(m, 2)} || '-' || {pad(dd, 2)}
        WHEN {p} >= 10 AND {m} > 0 THEN {pad(y, 4)} || '-' || {pad(m, 2)} ELSE {pad(y, 4)} END"""


def _pairs(c: Catalog) -> DataFrame:
    return c.v_date_pairs.select(
        "k", D.imprecise(F.col("a_time"), F.col("ap")).alias("a"),
        D.imprecise(F.col("b_time"), F.col("bp")).alias("b"),
    )


def _terms(c: Catalog) -> DataFrame:
    return c.v_terms.select(
        "k", "id", D.imprecise(F.col("start_time"), F.col("sp")).alias("start"),
        D.imprecise(F.col("end_time"), F.col("ep")).alias("end"),
    )


_TEXTS = f"""(SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'in 1999' WHEN o_orderkey % 17 = 0 THEN '1999-9'
    WHEN o_orderkey % 19 = 0 THEN '2001-99-99'
    ELSE {date_text('(9 + o_orderkey % 3)', 'year(o_orderdate)', 'month(o_orderdate)', 'day(o_orderdate)')} END AS t
    FROM orders) x"""


@query(f"""
    SELECT k, CASE WHEN length(t) = 4 THEN '+' || t || '-00-00T00:00:00Z'
                   WHEN length(t) = 7 AND t NOT LIKE 'in%' THEN '+' || t || '-00T00:00:00Z'
                   WHEN length(t) = 10 THEN '+' || t || 'T00:00:00Z' END AS time,
           CASE length(t) WHEN 4 THEN 9 WHEN 7 THEN 10 WHEN 10 THEN 11 ELSE 0 END AS length_precision
    FROM {_TEXTS}""")
def parse_date(c: Catalog) -> DataFrame:
    rows = c.sql(f"SELECT k, t FROM {_TEXTS}")
    return rows.select(
        "k", D.parse_date(F.col("t"))["time"].alias("time"),
        D.text_precision(F.col("t")).alias("length_precision"),
    )


@query("""
    SELECT k, CASE WHEN ap IS NULL THEN NULL WHEN asign = '-' THEN true
        WHEN ap = 8 THEN floor(ay / 10.0) * 10 + 9 < 1999
        WHEN ap = 7 THEN ay + 99 < 1999 WHEN ap = 6 THEN floor((ay - 1) / 1000.0) * 1000 + 1000 < 1999
        WHEN ap <= 9 THEN ay < 1999
        WHEN ap = 10 AND am > 0 THEN ay * 100 + am < 199901
        WHEN ap >= 11 AND am > 0 AND ad > 0 THEN ay * 10000 + am * 100 + ad < 19990131
        ELSE false END AS over_25
    FROM v_date_pairs""")
def over_years_ago(c: Catalog) -> DataFrame:
    return _pairs(c).select("k", D.over_years_ago(F.col("a"), 25, as_of()).alias("over_25"))


@query(f"SELECT k, {same_sql(A, B)} AS same FROM v_date_pairs")
def could_be_same(c: Catalog) -> DataFrame:
    return _pairs(c).select("k", D.could_be_same(F.col("a"), F.col("b")).alias("same"))


@query("""
    SELECT k, CASE WHEN ap IS NULL THEN b_time WHEN bp IS NULL THEN a_time WHEN ap > bp THEN a_time
                   WHEN bp > ap THEN b_time END AS finer FROM v_date_pairs""")
def more_precise(c: Catalog) -> DataFrame:
    return _pairs(c).select("k", D.more_precise(F.col("a"), F.col("b"))["time"].alias("finer"))


@query(f"SELECT k, {adjoin_sql(A, B)} AS adjoin FROM v_date_pairs")
def consecutive(c: Catalog) -> DataFrame:
    return _pairs(c).select("k", D.consecutive(F.col("a"), F.col("b")).alias("adjoin"))


@query("SELECT k, CAST(ay * 10000 + am * 100 + ad AS BIGINT) AS key FROM v_date_pairs WHERE ap IS NOT NULL")
def date_key(c: Catalog) -> DataFrame:
    return _pairs(c).where(F.col("a").isNotNull()).select("k", D.date_key(F.col("a")).alias("key"))


@query(f"SELECT k, {display_sql(A)} AS shown FROM v_date_pairs")
def display(c: Catalog) -> DataFrame:
    return _pairs(c).select("k", D.display(F.col("a")).alias("shown"))


S_, E_ = _cols("sp sy sm sd"), _cols("ep ey em ed")


@query(f"""
    SELECT id, CASE WHEN sp IS NOT NULL THEN ' (' || {display_sql(S_)} || ' - ' || coalesce({display_sql(E_)}, 'present') || ')'
                    WHEN ep IS NOT NULL THEN ' (until ' || {display_sql(E_)} || ')' ELSE '' END AS shown
    FROM v_terms""")
def timeframe_text(c: Catalog) -> DataFrame:
    """Read from the qualifier JSON of office facts."""
    return c.v_properties.where("type = 'P39'").select(
        "id", D.shown_timeframe(F.col("qualifiers_json")).alias("shown")
    )


_MONTHS = "CASE {m} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(D.MONTH_NAMES, 1)) + " END"


def _long_sql(d) -> str:
    p, y, m, dd = d
    return f"""CASE WHEN {p} IS NULL THEN NULL
        WHEN {p} >= 11 AND {m} > 0 AND {dd} > 0
            THEN {_MONTHS.format(m=m)} || ' ' || CAST({dd} AS STRING) || ', ' || CAST({y} AS STRING)
        WHEN {p} >= 10 AND {m} > 0 THEN {_MONTHS.format(m=m)} || ' ' || CAST({y} AS STRING)
        ELSE CAST({y} AS STRING) END"""


@query(f"""
    SELECT k, CASE WHEN sp IS NOT NULL AND ep IS NOT NULL THEN {_long_sql(S_)} || ' – ' || {_long_sql(E_)}
                   WHEN sp IS NOT NULL THEN {_long_sql(S_)} || ' – present'
                   WHEN ep IS NOT NULL THEN 'until ' || {_long_sql(E_)}
                   ELSE 'dates not specified' END AS shown FROM v_terms""")
def long_range(c: Catalog) -> DataFrame:
    return _terms(c).select("k", D.long_range(F.col("start"), F.col("end")).alias("shown"))


_SEVERAL = """
    SELECT k, politician_id, entity_id, time, precision, key, row_number() OVER (
        PARTITION BY politician_id, entity_id ORDER BY precision DESC, key, time) AS first_rank,
        row_number() OVER (PARTITION BY politician_id, entity_id ORDER BY precision DESC, key DESC, time DESC) AS last_rank
    FROM (SELECT k, politician_id, entity_id, start_time AS time, sp AS precision, sy * 10000 + sm * 100 + sd AS key
          FROM v_terms WHERE sp IS NOT NULL) s"""


@query(f"""
    SELECT politician_id, entity_id, max(CASE WHEN first_rank = 1 THEN time END) AS earliest,
           max(CASE WHEN last_rank = 1 THEN time END) AS latest
    FROM ({_SEVERAL}) r GROUP BY politician_id, entity_id""")
def best_date(c: Catalog) -> DataFrame:
    """Best date of all starts of an office, gathered to one value list as qualifiers hold them."""
    values = (
        _terms(c).join(c.v_terms.select("k", "politician_id", "entity_id"), "k")
        .where(F.col("start").isNotNull()).groupBy("politician_id", "entity_id")
        .agg(F.collect_set("start").alias("dates"))
    )
    return values.select(
        "politician_id", "entity_id", D.best_date(F.col("dates"), latest=False)["time"].alias("earliest"),
        D.best_date(F.col("dates"), latest=True)["time"].alias("latest"),
    )


@query(f"""
    SELECT k, '{{"time":"' || start_time || '","timezone":0,"before":0,"after":0,"precision":' || CAST(sp AS STRING)
           || ',"calendarmodel":"{D.CALENDAR_MODEL}"}}' AS value FROM v_terms WHERE sp IS NOT NULL""")
def time_value(c: Catalog) -> DataFrame:
    return _terms(c).where(F.col("start").isNotNull()).select("k", D.time_value(F.col("start")).alias("value"))


@query("""
    SELECT k, start_time AS time, CAST(sp AS INT) AS precision FROM v_terms WHERE sp IS NOT NULL""")
def date_from_parts(c: Catalog) -> DataFrame:
    def part(name: str) -> Column:
        return F.when(F.col(name) > 0, F.lpad(F.col(name).cast("string"), 2, "0"))

    rows = c.v_terms.where("sp IS NOT NULL")
    made = D.date_from_parts(F.lpad(F.col("sy").cast("string"), 4, "0"), part("sm"), part("sd"))
    return rows.select("k", made["time"].alias("time"), made["precision"].alias("precision"))


# --- facts ----------------------------------------------------------------------------------

# candidate and fact date parts as SQL; unsigned births read as no date
_FACTS = """
    facts AS (
        SELECT p.id, p.politician_id, p.type, p.created_at,
               CASE WHEN p.type = 'P569' THEN '' ELSE coalesce(p.entity_id, '') END AS place,
               CASE WHEN p.type = 'P569' AND b.k % 29 <> 7 AND b.k % 53 <> 9 THEN b.p END AS bp,
               b.y AS bq, CASE WHEN b.p >= 10 THEN b.m ELSE 0 END AS bm, CASE WHEN b.p = 11 THEN b.d ELSE 0 END AS bd,
               CASE WHEN p.type = 'P569' AND b.k % 53 = 9 AND b.k % 29 <> 7 THEN 1 ELSE 0 END AS odd,
               t.sp, t.sy, t.sm, t.sd, t.ep, t.ey, t.em, t.ed
        FROM v_properties p
        LEFT JOIN v_births b ON b.politician_id = p.politician_id AND p.type = 'P569'
        LEFT JOIN v_terms t ON t.id = p.id
        WHERE p.deleted_at IS NULL)"""


def _text_parts(column: str, prefix: str) -> str:
    return f"""CASE length({column}) WHEN 4 THEN 9 WHEN 7 THEN 10 WHEN 10 THEN 11 END AS {prefix}p,
        CAST(substr({column}, 1, 4) AS INT) AS {prefix}y,
        CASE WHEN length({column}) >= 7 THEN CAST(substr({column}, 6, 2) AS INT) ELSE 0 END AS {prefix}m,
        CASE WHEN length({column}) = 10 THEN CAST(substr({column}, 9, 2) AS INT) ELSE 0 END AS {prefix}d"""


_CANDS = f"""
    cands AS (
        SELECT seq, politician_id, kind AS type, CASE WHEN kind = 'P569' THEN '' ELSE coalesce(entity_id, '') END AS place,
               {_text_parts('value', 'cv')}, {_text_parts('start_date', 'cs')}, {_text_parts('end_date', 'ce')}
        FROM v_extractions WHERE value IS NULL OR value NOT LIKE 'about%')"""

_V, _CS, _CE = _cols("cvp cvy cvm cvd"), _cols("csp csy csm csd"), _cols("cep cey cem ced")


def _frame_verdict(a_s, a_e, b_s, b_e) -> str:
    a_dated, b_dated = f"({a_s[0]} IS NOT NULL OR {a_e[0]} IS NOT NULL)", f"({b_s[0]} IS NOT NULL OR {b_e[0]} IS NOT NULL)"
    a_finer = f"({finer_sql(a_s, b_s)} OR {finer_sql(a_e, b_e)})"
    b_finer = f"({finer_sql(b_s, a_s)} OR {finer_sql(b_e, a_e)})"
    return f"""CASE WHEN {a_dated} AND NOT {b_dated} THEN 'SELF_MORE_PRECISE'
        WHEN {b_dated} AND NOT {a_dated} THEN 'OTHER_MORE_PRECISE'
        WHEN NOT ({same_sql(a_s, b_s)} AND {same_sql(a_e, b_e)}) THEN 'NO_MATCH'
        WHEN {a_finer} AND NOT {b_finer} THEN 'SELF_MORE_PRECISE'
        WHEN {b_finer} AND NOT {a_finer} THEN 'OTHER_MORE_PRECISE' ELSE 'EQUAL' END"""


def _date_verdict(a, b) -> str:
    return f"""CASE WHEN NOT {same_sql(a, b)} THEN 'NO_MATCH' WHEN {finer_sql(a, b)} THEN 'SELF_MORE_PRECISE'
        WHEN {finer_sql(b, a)} THEN 'OTHER_MORE_PRECISE' ELSE 'EQUAL' END"""


_VERDICT = f"""CASE WHEN c.type = 'P569' THEN {_date_verdict(_V, B)}
    WHEN c.type = 'P39' THEN {_frame_verdict(_CS, _CE, S_, E_)} ELSE 'EQUAL' END"""


def candidates(c: Catalog) -> DataFrame:
    quotes = F.array(F.concat(F.lit("quote "), (F.col("seq") % 5).cast("string")))
    return R.candidate_rows(c.v_extractions.withColumn("supporting_quotes", quotes)).valid


def _usable_facts(c: Catalog) -> DataFrame:
    """Facts without the ones that break the table rule."""
    broken = R.invalid_facts(c.v_properties).select("id")
    return c.v_properties.join(broken, "id", "left_anti")


@query(f"""
    SELECT k, CASE WHEN k % 6 = 0 THEN 'NO_MATCH' WHEN k % 6 < 3 THEN {_date_verdict(A, B)}
                   ELSE {_frame_verdict(A, B, B, A)} END AS verdict
    FROM v_date_pairs""")
def compare_facts(c: Catalog) -> DataFrame:
    """All pairs; years are compared without their sign, so 44 BCE and 44 CE are the same."""
    return _fact_verdicts(_pairs(c))


@query(f"""
    SELECT k, CASE WHEN k % 6 = 0 THEN 'NO_MATCH' WHEN k % 6 < 3 THEN {_date_verdict(B, A)}
                   ELSE {_frame_verdict(B, A, A, B)} END AS verdict
    FROM v_date_pairs""")
def compare_all_facts(c: Catalog) -> DataFrame:
    """All pairs the other way around."""
    return _fact_verdicts(_pairs(c).select("k", F.col("b").alias("a"), F.col("a").alias("b")))


def _fact_verdicts(pairs: DataFrame) -> DataFrame:
    """Pairs of facts made of the date pairs: of different type, births, and office terms."""
    k = F.col("k")

    def fact(type_: Column, date: Column, start: Column, end: Column) -> Column:
        return F.struct(
            type_.alias("type"), date.alias("date"), start.alias("start"), end.alias("end"),
            F.lit("P1").alias("entity_id"),
        )

    a, b = F.col("a"), F.col("b")
    kind = F.when(k % 6 < 3, "P569").otherwise("P39")
    return pairs.select(
        "k",
        R.compare_facts(
            fact(F.when(k % 6 == 0, "P19").otherwise(kind), a, a, b), fact(kind, b, b, a)
        ).alias("verdict"),
    )


@query(f"""
    WITH {_FACTS}, {_CANDS}, matches AS (
        SELECT c.seq, f.id, row_number() OVER (PARTITION BY c.seq ORDER BY f.created_at, f.id) AS n
        FROM cands c JOIN facts f ON f.politician_id = c.politician_id AND f.type = c.type AND f.place = c.place
        WHERE f.odd = 0 AND {_VERDICT} IN ('EQUAL', 'OTHER_MORE_PRECISE'))
    SELECT seq, id AS fact_id FROM matches WHERE n = 1""")
def match_facts(c: Catalog) -> DataFrame:
    cands = candidates(c)
    return cands.select("cand_id", "seq").join(
        R.match_facts(cands, _usable_facts(c)), "cand_id"
    ).select("seq", "fact_id")


_ISLANDS = f"""
    WITH {_FACTS}, {_CANDS}, dated AS (
        SELECT *, row_number() OVER (PARTITION BY politician_id, place
            ORDER BY sy * 10000 + sm * 100 + sd, sp, coalesce(ep, -1), coalesce(ey * 10000 + em * 100 + ed, -1), id) AS n
        FROM facts WHERE type = 'P39' AND sp IS NOT NULL),
    linked AS (
        SELECT a.*, CASE WHEN b.ep IS NOT NULL AND {adjoin_sql(_cols('b.ep b.ey b.em b.ed'), _cols('a.sp a.sy a.sm a.sd'))}
                         THEN 0 ELSE 1 END AS gap
        FROM dated a LEFT JOIN dated b ON a.politician_id = b.politician_id AND a.place = b.place AND b.n = a.n - 1),
    islands AS (
        SELECT *, sum(gap) OVER (PARTITION BY politician_id, place ORDER BY n
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM linked),
    chains AS (
        SELECT *, max(n) OVER (PARTITION BY politician_id, place, island) AS last_n FROM islands),
    runs AS (
        SELECT a.id, a.politician_id, a.place, a.n, a.sp, a.sy, a.sm, a.sd, b.ep, b.ey, b.em, b.ed, b.id AS last_id
        FROM chains a JOIN dated b ON a.politician_id = b.politician_id AND a.place = b.place AND b.n = a.last_n)"""


@query(f"""{_ISLANDS}
    SELECT politician_id, place, count(*) AS terms, count(DISTINCT last_id) AS runs,
           sum(CASE WHEN ep IS NULL THEN 1 ELSE 0 END)::BIGINT AS open_terms
    FROM runs GROUP BY politician_id, place""")
def chain_ends(c: Catalog) -> DataFrame:
    """Runs of consecutive terms per office; every office is looked at."""
    blocks = c.v_terms.select("politician_id", F.col("entity_id").alias("place")).distinct()
    chains = R.chain_ends(written(R._office_terms(c.v_properties, blocks), "terms"))
    return chains.groupBy("politician_id", "place").agg(
        F.sum("weight").alias("terms"), F.sum(F.col("gap") * F.col("weight")).alias("runs"),
        F.sum(F.when(F.col("chain_end").isNull(), F.col("weight")).otherwise(0)).alias("open_terms"),
    )


@query(f"""{_ISLANDS}, many AS (
        SELECT politician_id, place FROM facts WHERE type = 'P39' GROUP BY politician_id, place HAVING count(*) >= 2)
    SELECT DISTINCT c.seq FROM cands c
    JOIN many m ON m.politician_id = c.politician_id AND m.place = c.place
    JOIN runs r ON r.politician_id = c.politician_id AND r.place = c.place
    WHERE c.type = 'P39' AND c.csp IS NOT NULL AND {same_sql(_CS, _cols('r.sp r.sy r.sm r.sd'))}
      AND NOT {finer_sql(_CS, _cols('r.sp r.sy r.sm r.sd'))} AND {same_sql(_CE, _cols('r.ep r.ey r.em r.ed'))}
      AND NOT (c.cep IS NOT NULL AND c.cep > r.ep)""")
def subsumed(c: Catalog) -> DataFrame:
    cands = candidates(c)
    told = R.subsumed(cands, c.v_properties)
    return cands.select("cand_id", "seq").join(told, "cand_id", "left_semi").select("seq")


def _text_time_sql(t: str) -> str:
    return f"""CASE length({t}) WHEN 4 THEN '+' || {t} || '-00-00T00:00:00Z' WHEN 7 THEN '+' || {t} || '-00T00:00:00Z'
        WHEN 10 THEN '+' || {t} || 'T00:00:00Z' END"""


@query(f"""
    WITH e AS (SELECT *, coalesce(value LIKE 'about%', false) AS bad FROM v_extractions)
    SELECT CASE WHEN bad THEN 'rejected' ELSE 'candidate' END AS outcome, seq, politician_id, source_id, kind AS type,
           CASE WHEN bad THEN value ELSE {_text_time_sql('value')} END AS value,
           CASE WHEN bad THEN NULL ELSE CAST(CASE length(value) WHEN 4 THEN 9 WHEN 7 THEN 10 WHEN 10 THEN 11 END AS INTEGER) END AS precision,
           CASE WHEN kind <> 'P569' THEN entity_id END AS entity_id,
           {_text_time_sql('start_date')} AS start_time, {_text_time_sql('end_date')} AS end_time
    FROM e""")
def candidate_rows(c: Catalog) -> DataFrame:
    """All extraction results: candidates with their dates, and those set aside as they came."""
    out = R.candidate_rows(c.v_extractions.withColumn("supporting_quotes", F.array().cast("array<string>")))

    def time(prop: str) -> Column:
        return F.get_json_object("qualifiers_json", f"$.{prop}[0].datavalue.value.time")

    none = F.lit(None).cast("string")
    valid = out.valid.select(
        F.lit("candidate").alias("outcome"), "seq", "politician_id", "source_id", "type", "value",
        F.col("value_precision").alias("precision"), "entity_id", time("P580").alias("start_time"), time("P582").alias("end_time"),
    )
    return valid.union(out.rejected.select(
        F.lit("rejected"), "seq", "politician_id", "source_id", "kind", "value", none.cast("int"), none, none, none
    ))


@query("SELECT source_id, count(*) AS items FROM v_extractions GROUP BY source_id")
def extraction_counts(c: Catalog) -> DataFrame:
    return R.extraction_counts(c.v_extractions)


@query("SELECT id FROM v_properties WHERE type = 'P569' AND value_precision IS NULL")
def invalid_facts(c: Catalog) -> DataFrame:
    return R.invalid_facts(c.v_properties).select("id")


@query("""
    SELECT id FROM v_sources WHERE (coalesce(error, '') = 'FETCH_ERROR' AND http_status_code IS NULL)
        OR (coalesce(error, '') <> 'FETCH_ERROR' AND http_status_code IS NOT NULL)""")
def invalid_sources(c: Catalog) -> DataFrame:
    return R.invalid_sources(c.v_sources).select("id")


@query("""
    SELECT property_id, source_id, string_agg(quote, '|' ORDER BY quote) AS quotes
    FROM v_quotes GROUP BY property_id, source_id""")
def merge_references(c: Catalog) -> DataFrame:
    """All references twice, one quote in each row."""
    rows = c.v_quotes.select("property_id", "source_id", F.array("quote").alias("supporting_quotes"))
    return R.merge_references(rows, rows).select(
        "property_id", "source_id", F.array_join("supporting_quotes", "|").alias("quotes")
    )


@query()
def merge_extractions(c: Catalog) -> DataFrame:
    """Sequential by nature: checked against a replay in the tests."""
    refs = c.v_quotes.select("property_id", "source_id", F.array("quote").alias("supporting_quotes"))
    merged = R.merge_extractions(_usable_facts(c), refs, candidates(c))
    return merged.assigned.select("cand_id", "property_id", F.lit("assigned").alias("outcome")).unionByName(
        merged.dropped.select("cand_id", F.lit(None).cast("string").alias("property_id"),
                              F.lit("dropped").alias("outcome"))
    )


def quote_fixture(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """Documents as pages, each paragraph its own element, and quotes of each: its first sentence,
    its last words with the first of the next paragraph, its second paragraph whole, and one with
    words that it does not have."""
    text = F.col("text")
    html = F.concat(
        F.lit("<html><body><script>var quote;</script><p>"),
        F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                  F.lit("\n"), F.lit("</p><p>")),
        F.lit("</p></body></html>"),
    )
    pages = c.table("documents").select(F.col("doc_id").alias("source_id"), html.alias("html"))
    first = F.upper(F.substring_index(F.substring_index(text, "\n", 1), ".", 1))
    lines = F.split(text, "\n")
    last = F.element_at(F.split(F.get(lines, F.lit(0)), " "), -1)
    across = F.concat(last, F.lit(" "), F.get(F.split(F.get(lines, F.lit(1)), " "), F.lit(0)))
    quotes = F.array(first, across, F.get(lines, F.lit(1)), F.concat(first, F.lit(" no such words")))
    refs = c.table("documents").select(
        F.col("doc_id").alias("property_id"), F.col("doc_id").alias("source_id"),
        F.array_compact(quotes).alias("supporting_quotes"),
    )
    return refs, pages


@query()
def verify_quotes(c: Catalog) -> DataFrame:
    """Checked against a token-by-token search in the tests."""
    refs, pages = quote_fixture(c)
    return P.verify_quotes(refs, pages)
