"""Column functions over one dump entity: labels, truthy claims, claim values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kbcurate.functions import dates
from kbcurate.functions.once import once


def _value(texts: Column, lang: str) -> Column:
    return F.try_element_at(texts, F.lit(lang))["value"]


def best_text(texts: Column) -> Column:
    """The ``mul`` text, else ``en``, else the first in document order, else null."""
    return F.coalesce(
        _value(texts, "mul"), _value(texts, "en"),
        F.get(F.map_values(texts), F.lit(0))["value"],
    )


def all_labels(texts: Column) -> Column:
    """Distinct texts over all languages."""
    values = F.transform(F.map_values(texts), lambda t: t["value"])
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull()))


def label(texts: Column, lang: str) -> Column:
    return _value(texts, lang)


def aliases(alias_map: Column, lang: str) -> Column:
    return F.transform(F.try_element_at(alias_map, F.lit(lang)), lambda a: a["value"])


def qid_number(qid: Column) -> Column:
    """The number of a ``Q`` id, null for anything else."""
    return F.when(qid.startswith("Q"), F.substr(qid, F.lit(2)).try_cast("int"))


def truthy(claims: Column, prop: str) -> Column:
    """Claims of a property that count: the preferred ones if any, else all that are not
    deprecated. A missing rank is normal; a missing property gives an empty array."""
    found = claims[prop]

    def preferred(c: Column) -> Column:
        return c["rank"].eqNullSafe("preferred")

    return F.coalesce(
        F.when(F.exists(found, preferred), F.filter(found, preferred))
        .otherwise(F.filter(found, lambda c: ~c["rank"].eqNullSafe("deprecated"))),
        F.array(),
    )


def claim_value(claim: Column) -> Column:
    return claim["mainsnak"]["datavalue"]["value"]


# The form items are written in, and the id in it; other values are read as JSON, which costs a reader each.
_ITEM = r'^\{(?:"entity-type":"[a-z]+",)?(?:"numeric-id":[0-9]+,)?"id":"([^"\\]+)"\}$'


def claim_entity(claim: Column) -> Column:
    """The item a claim points at, null without a value."""
    def item(value: Column) -> Column:
        plain = F.nullif(F.regexp_extract(value, _ITEM, 1), F.lit(""))
        return F.coalesce(plain, F.get_json_object(value, "$.id"))

    return once(claim_value(claim), item)


def claim_date(claim: Column) -> Column:
    """The imprecise date of a claim: only time values, precision 11 when missing."""
    datavalue = claim["mainsnak"]["datavalue"]
    precision = F.coalesce(F.get_json_object(datavalue["value"], "$.precision").try_cast("int"), F.lit(11))
    return F.when(
        datavalue["type"] == "time",
        once(F.get_json_object(datavalue["value"], "$.time"), lambda time: dates.imprecise(time, precision)),
    )


def entity_ids(claims: Column, prop: str) -> Column:
    """Distinct items a property points at, claims without a value skipped."""
    ids = F.transform(truthy(claims, prop), claim_entity)
    return F.array_distinct(F.filter(ids, lambda i: i.isNotNull()))


def class_ids(claims: Column) -> Column:
    """Classes of an entity: its instance-of and subclass-of items."""
    return F.array_union(entity_ids(claims, "P31"), entity_ids(claims, "P279"))


def first_value(claims: Column, prop: str) -> Column:
    """First usable text value of a property."""
    values = F.transform(truthy(claims, prop), claim_value)
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))
