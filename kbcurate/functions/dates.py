"""Imprecise dates as Column functions.

A date is a struct of a signed time string such as ``+1970-06-00T00:00:00Z``, a precision from 0
to 14 (6 millennium, 7 century, 8 decade, 9 year, 10 month, 11 day) and the year, month and day
read from the string once (month and day null for ``00``). Strings are kept because BCE years and
``00`` months do not fit a DATE. The sign is dropped when parts are read, so 44 BCE and 44 CE have
the same year in every comparison but :func:`over_years_ago`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kbcurate.functions.once import once

DATE_TYPE = "struct<time:string,precision:int,y:int,m:int,d:int>"

MILLENNIUM, CENTURY, DECADE, YEAR, MONTH, DAY = 6, 7, 8, 9, 10, 11

# Fixed value: the calendar every written date names.
CALENDAR_MODEL = "http://www.wikidata.org/entity/Q1985727"


# --- construction and parts -----------------------------------------------------------------


def dated(time: Column, precision: Column) -> Column:
    """The date struct of a signed time string."""
    digits = F.split(F.substr(F.substring_index(time, "T", 1), F.lit(2)), "-")

    def part(index: int) -> Column:
        return F.get(digits, F.lit(index)).try_cast("int")

    return F.struct(
        time.alias("time"), precision.cast("int").alias("precision"), part(0).alias("y"),
        F.nullif(part(1), F.lit(0)).alias("m"), F.nullif(part(2), F.lit(0)).alias("d"),
    )


def imprecise(time: Column, precision: Column) -> Column:
    """A date from a raw time string and precision; null unless the string carries a sign."""
    return F.when(time.rlike("^[+-]"), dated(time, precision))


def no_date() -> Column:
    return F.lit(None).cast(DATE_TYPE)


def year(d: Column) -> Column:
    return d["y"]


def month(d: Column) -> Column:
    return d["m"]


def day(d: Column) -> Column:
    return d["d"]


def _p(d: Column) -> Column:
    return d["precision"]


def _month0(d: Column) -> Column:
    return F.coalesce(month(d), F.lit(0))


def _day0(d: Column) -> Column:
    return F.coalesce(day(d), F.lit(0))


def date_key(d: Column) -> Column:
    """Chronological sort key: year, month or 0, day or 0, as one number."""
    return year(d).cast("long") * 10000 + _month0(d) * 100 + _day0(d)


def text_time(text: Column) -> Column:
    """Time string of ``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD`` by shape only (month 99 passes);
    else null."""
    return F.when(
        text.rlike(r"^\d{4}(-\d{2}){0,2}$"),
        F.concat(F.lit("+"), F.rpad(F.concat(text, F.substr(F.lit("-00-00"), F.length(text) - 3)), 10, "0"),
                 F.lit("T00:00:00Z")),
    )


def parse_date(text: Column) -> Column:
    """The date of a text :func:`text_time` accepts; else null."""
    return imprecise(text_time(text), text_precision(text))


def text_precision(text: Column) -> Column:
    """Precision of a date text by its length; 0 for null or any other length."""
    size = F.length(text)
    return (
        F.when(size == 4, YEAR).when(size == 7, MONTH).when(size == 10, DAY).otherwise(0)
    )


def date_from_parts(y: Column, m: Column, d: Column) -> Column:
    """A date from year, month and day texts, any of the last two missing or empty."""
    m, d = F.nullif(m, F.lit("")), F.nullif(d, F.lit(""))
    time = F.concat(
        F.lit("+"), y, F.lit("-"), F.coalesce(m, F.lit("00")), F.lit("-"),
        F.coalesce(d, F.lit("00")), F.lit("T00:00:00Z"),
    )
    precision = F.when(m.isNull(), YEAR).when(d.isNull(), MONTH).otherwise(DAY)
    return dated(time, precision)


# --- predicates -----------------------------------------------------------------------------


def is_bce(d: Column) -> Column:
    return d["time"].startswith("-")


def over_years_ago(d: Column, years: int, as_of: Column) -> Column:
    """Certainly more than ``years`` before ``as_of``: judged by the latest day the precision
    allows, strictly. BCE is always true; a missing month or day that is needed is false."""
    y, m, dd, p = year(d), month(d), day(d), _p(d)
    cut_y = F.year(as_of) - years
    cut_m, cut_d = F.month(as_of), F.dayofmonth(as_of)
    latest = (
        F.when(p == DECADE, F.floor(y / 10) * 10 + 9)
        .when(p == CENTURY, y + 99)
        .when(p == MILLENNIUM, F.floor((y - 1) / 1000) * 1000 + 1000)
        .otherwise(y)
    )
    verdict = (
        F.when(is_bce(d), F.lit(True))
        .when(p <= YEAR, latest < cut_y)
        .when((p == MONTH) & m.isNotNull(), y * 100 + m < cut_y * 100 + cut_m)
        .when(
            (p >= DAY) & m.isNotNull() & dd.isNotNull(),
            y * 10000 + m * 100 + dd < cut_y * 10000 + cut_m * 100 + cut_d,
        )
        .otherwise(F.lit(False))
    )
    return F.when(d.isNotNull(), verdict)


def span(d: Column) -> Column:
    """The period a date names, as struct<level,own,key,low,high>: its precision, its own number at that
    precision, its sort key, and the least and greatest sort key of a finer date in it. A precision
    below a millennium or beyond a day holds no finer date."""
    p, y = _p(d), year(d).cast("long")
    key = y * 10000 + _month0(d) * 100 + _day0(d)
    month_key = y * 10000 + _month0(d) * 100
    whole_years = p.between(MILLENNIUM, YEAR)
    years = F.when(p == MILLENNIUM, 1000).when(p == CENTURY, 100).when(p == DECADE, 10).otherwise(1)
    first = F.when(p == MILLENNIUM, F.floor((y - 1) / 1000) * 1000 + 1).when(p == DECADE, F.floor(y / 10) * 10).otherwise(y)
    low = F.when(whole_years, first * 10000).when(p == MONTH, month_key).when(p == DAY, key).otherwise(1)
    high = F.when(whole_years, (first + years) * 10000 - 1).when(p == MONTH, month_key + 99).when(p == DAY, key).otherwise(0)
    own = F.when(p <= YEAR, y * 10000).when(p == MONTH, month_key).otherwise(key)
    return F.struct(p.alias("level"), own.alias("own"), key.alias("key"), low.alias("low"), high.alias("high"))


def may_agree(a: Column, b: Column) -> Column:
    """:func:`could_be_same` of two spans: equal at a shared level, or the finer one's key in the period
    of the coarser."""
    return F.when(a["level"] == b["level"], a["own"] == b["own"]).otherwise(
        F.when(a["level"] < b["level"], b["key"].between(a["low"], a["high"]))
        .otherwise(a["key"].between(b["low"], b["high"]))
    )


def could_be_same(a: Column, b: Column) -> Column:
    """Two dates may name the same time: equal at a shared precision, or the finer one falls in
    the period of the coarser one. Two nulls agree, one null never does."""
    # each span is made once, as an element that a lambda is given
    both = F.array(F.struct(span(a).alias("a"), span(b).alias("b")))
    verdict = F.get(F.transform(both, lambda x: may_agree(x["a"], x["b"])), F.lit(0))
    return F.when(a.isNull() & b.isNull(), F.lit(True)).when(a.isNull() | b.isNull(), F.lit(False)).otherwise(verdict)


def more_precise(a: Column, b: Column) -> Column:
    """The finer date; null loses to any date, equal precision gives null."""
    return (
        F.when(a.isNull(), b).when(b.isNull(), a)
        .when(_p(a) > _p(b), a).when(_p(b) > _p(a), b)
    )


def finer(a: Column, b: Column) -> Column:
    """``a`` is the more precise of the two."""
    return a.isNotNull() & F.coalesce(_p(a) > _p(b), F.lit(True))


def _calendar_day(d: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d", year(d), month(d), day(d))
    return F.try_to_date(text, "yyyy-MM-dd")


def consecutive(end: Column, start: Column) -> Column:
    """One term ends where the next starts: same precision (year, month or day only) and zero
    or one unit apart. Days that do not exist are never consecutive."""
    months = (year(start) - year(end)) * 12 + month(start) - month(end)
    days = F.datediff(_calendar_day(start), _calendar_day(end))
    gap = (
        F.when(_p(end) == YEAR, year(start) - year(end))
        .when(_p(end) == MONTH, months)
        .when(_p(end) == DAY, days)
    )
    return F.coalesce((_p(end) == _p(start)) & gap.between(0, 1), F.lit(False))


# --- display --------------------------------------------------------------------------------

# English month names.
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]


def display(d: Column) -> Column:
    """``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD`` at the stored precision."""
    return (
        F.when(
            (_p(d) >= DAY) & month(d).isNotNull() & day(d).isNotNull(),
            F.format_string("%04d-%02d-%02d", year(d), month(d), day(d)),
        )
        .when((_p(d) >= MONTH) & month(d).isNotNull(), F.format_string("%04d-%02d", year(d), month(d)))
        .when(d.isNotNull(), F.format_string("%04d", year(d)))
    )


def timeframe_text(start: Column, end: Column) -> Column:
    """`` (start - end)``, `` (start - present)``, `` (until end)`` or empty."""
    return (
        F.when(
            start.isNotNull(),
            F.concat(F.lit(" ("), display(start), F.lit(" - "),
                     F.coalesce(display(end), F.lit("present")), F.lit(")")),
        )
        .when(end.isNotNull(), F.concat(F.lit(" (until "), display(end), F.lit(")")))
        .otherwise(F.lit(""))
    )


def long_date(d: Column) -> Column:
    """``March 15, 2020``, ``March 2020`` or ``2020``. A day past the month's end rolls over."""
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    first = F.try_to_date(F.format_string("%04d-%02d-01", year(d), month(d)), "yyyy-MM-dd")
    shown = F.date_add(first, day(d) - 1)
    return (
        F.when(
            (_p(d) >= DAY) & month(d).isNotNull() & day(d).isNotNull(),
            F.concat(F.get(names, F.month(shown) - 1), F.lit(" "),
                     F.dayofmonth(shown).cast("string"), F.lit(", "), F.year(shown).cast("string")),
        )
        .when(
            (_p(d) >= MONTH) & month(d).isNotNull(),
            F.concat(F.get(names, month(d) - 1), F.lit(" "), year(d).cast("string")),
        )
        .when(d.isNotNull(), year(d).cast("string"))
    )


def long_range(start: Column, end: Column) -> Column:
    dash = F.lit(" – ")
    return (
        F.when(start.isNotNull() & end.isNotNull(), F.concat(long_date(start), dash, long_date(end)))
        .when(start.isNotNull(), F.concat(long_date(start), dash, F.lit("present")))
        .when(end.isNotNull(), F.concat(F.lit("until "), long_date(end)))
        .otherwise(F.lit("dates not specified"))
    )


# --- qualifiers -----------------------------------------------------------------------------

_SNAKS = "array<struct<datavalue:struct<value:struct<time:string,precision:int>>>>"
QUALIFIER_DATES = f"struct<P580:{_SNAKS},P582:{_SNAKS}>"


def _first_date(snaks: Column) -> Column:
    value = F.get(snaks, F.lit(0))["datavalue"]["value"]
    return F.when(value["precision"].isNotNull(), imprecise(value["time"], value["precision"]))


def with_qualifiers(df: DataFrame, qualifiers_json: Column) -> DataFrame:
    """Adds the columns P580 and P582 (value lists). The text goes through a generator, so it is
    parsed once however often the dates are used."""
    text = F.coalesce(qualifiers_json, F.lit("{}"))
    return df.select("*", F.inline(F.array(F.from_json(text, QUALIFIER_DATES))))


def first_date(values: str) -> Column:
    """First value of a list :func:`with_qualifiers` added."""
    return _first_date(F.col(values))


def timeframe(qualifiers_json: Column) -> Column:
    """``struct<start,end>`` of a qualifier text: its first P580 and first P582 value. A
    qualifier without a value counts as absent."""
    return once(F.from_json(qualifiers_json, QUALIFIER_DATES), _frame)


def _frame(parsed: Column) -> Column:
    return F.struct(
        _first_date(parsed["P580"]).alias("start"), _first_date(parsed["P582"]).alias("end")
    )


def shown_timeframe(qualifiers_json: Column) -> Column:
    """:func:`timeframe_text` of a qualifier text, which is parsed once."""
    def shown(frame: Column) -> Column:
        return timeframe_text(frame["start"], frame["end"])

    parsed = F.from_json(qualifiers_json, QUALIFIER_DATES)
    return once(once(parsed, _frame), shown)


def best_date(dates: Column, latest: bool) -> Column:
    """Of several dates the most precise, then the earliest (or latest)."""
    usable = F.filter(dates, lambda d: d["time"].isNotNull() & (d["precision"] > 0))

    def keyed(d: Column) -> Column:
        sign = 1 if latest else -1
        return F.struct(d["precision"], date_key(d) * sign, d["time"].alias("time"))

    best = F.array_max(F.transform(usable, keyed))
    return F.when(best.isNotNull(), dated(best["time"], best["precision"]))


def qualifier_dates(qualifiers_json: Column, prop: str) -> Column:
    """All dates of one qualifier property, as an array for :func:`best_date`."""
    return value_dates(F.from_json(qualifiers_json, QUALIFIER_DATES)[prop])


def value_dates(values: Column) -> Column:
    return F.transform(
        values,
        lambda s: dated(s["datavalue"]["value"]["time"], s["datavalue"]["value"]["precision"]),
    )


def time_content(d: Column) -> Column:
    return F.struct(
        d["time"].alias("time"),
        F.lit(0).alias("timezone"),
        F.lit(0).alias("before"),
        F.lit(0).alias("after"),
        d["precision"].alias("precision"),
        F.lit(CALENDAR_MODEL).alias("calendarmodel"),
    )


def time_value(d: Column) -> Column:
    """JSON of the core time value."""
    return F.when(d.isNotNull(), F.to_json(time_content(d)))


def _time_snak(d: Column) -> Column:
    return F.struct(
        F.lit("time").alias("datatype"),
        F.lit("value").alias("snaktype"),
        F.struct(F.lit("time").alias("type"), time_content(d).alias("value")).alias("datavalue"),
    )


def time_qualifier(d: Column) -> Column:
    """JSON of a date in the shape qualifiers use."""
    return F.when(d.isNotNull(), F.to_json(_time_snak(d)))


def term_qualifiers(start: Column, end: Column) -> Column:
    """Qualifier JSON of an office term (P580/P582); null when neither date is known."""
    return F.when(
        start.isNotNull() | end.isNotNull(),
        F.to_json(
            F.struct(
                F.when(start.isNotNull(), F.array(_time_snak(start))).alias("P580"),
                F.when(end.isNotNull(), F.array(_time_snak(end))).alias("P582"),
            )
        ),
    )


# --- hashing imprecise dates ----------------------------------------------------------------
#
# could_be_same is no equivalence (1962-06 ~ 1962 ~ 1962-07), so it cannot be a grouping key, and
# comparing all pairs of a block is quadratic. But every true pair is one of three relations, each
# of them an equality of derived keys: same precision (own keys equal), b finer (a container key of
# a is among the ancestor keys of b), or a finer (the reverse). Joins use these keys.

# They are written as SQL text over the name of a date column.

_MONTH_NUMBER = "({d}.y * 100 + coalesce({d}.m, 0))"
_DAY_NUMBER = "({d}.y * 10000 + coalesce({d}.m, 0) * 100 + coalesce({d}.d, 0))"
_NO_KEYS = "CAST(array() AS ARRAY<STRING>)"
_BUCKETS = {
    MILLENNIUM: "floor(({d}.y - 1) / 1000)",
    DECADE: "floor({d}.y / 10)",
    YEAR: "{d}.y",
    MONTH: _MONTH_NUMBER,
    DAY: _DAY_NUMBER,
}


def own_key(name: str) -> Column:
    """The date at its own precision; a mark of its own for no date."""
    d = f"`{name}`"
    number = (
        f"CASE WHEN {d}.precision <= {YEAR} THEN {d}.y "
        f"WHEN {d}.precision = {MONTH} THEN {_MONTH_NUMBER} ELSE {_DAY_NUMBER} END"
    ).format(d=d)
    return F.expr(
        f"CASE WHEN {d} IS NULL THEN '-' ELSE concat('=', {d}.precision, ':', {number}) END"
    )


def ancestor_keys(name: str) -> Column:
    """Keys of every coarser period the date falls in."""
    d = f"`{name}`"
    keys = [
        f"IF({d}.precision > {q}, concat('<{q}:', {bucket.format(d=d)}), NULL)"
        for q, bucket in _BUCKETS.items()
    ] + [
        f"IF({d}.precision > {CENTURY}, concat('<7y:', {d}.y), NULL)",
        f"IF({d}.precision > {CENTURY}, concat('<7d:', floor({d}.y / 10)), NULL)",
    ]
    return F.expr(f"IF({d} IS NULL, {_NO_KEYS}, array_compact(array({', '.join(keys)})))")


def container_keys(name: str) -> Column:
    """Keys a finer date shares when it falls in this one. A century may start at any year: it
    is covered by its whole decades and the single years around them."""
    d = f"`{name}`"
    first, end = f"CAST(ceil({d}.y / 10) AS INT)", f"CAST(floor(({d}.y + 100) / 10) AS INT)"
    decades = f"transform(sequence({first}, {end} - 1), x -> concat('<7d:', x))"
    years = (
        f"transform(concat(sequence({d}.y, {first} * 10 - 1), sequence({end} * 10, {d}.y + 99)), "
        "x -> concat('<7y:', x))"
    )
    levels = " ".join(
        f"WHEN {q} THEN array(concat('<{q}:', {bucket.format(d=d)}))" for q, bucket in _BUCKETS.items()
    )
    return F.expr(
        f"CASE {d}.precision {levels} WHEN {CENTURY} THEN "
        f"concat({decades}, IF({d}.y % 10 = 0, {_NO_KEYS}, {years})) ELSE {_NO_KEYS} END"
    )
