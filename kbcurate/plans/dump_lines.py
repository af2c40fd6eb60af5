"""Dump lines made straight from the bundled tables: the text a dump would hold for them.

``v_texts``, ``v_sitelinks`` and ``v_claims`` tell the same content as rows, from which the
checking SQL works; the parser only ever sees these lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kbcurate.functions.once import once
from kbcurate.plans.views import Catalog


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _joined(items: list[Column]) -> Column:
    return F.array_join(F.array(*items), ",")  # nulls are left out


def _claim(value: Column | None, sid: Column | None, rank: Column | str | None = "normal") -> Column:
    snak = F.lit('"snaktype":"novalue"')
    if value is not None:
        snak = F.coalesce(_text('"snaktype":"value","datavalue":', value), snak)
    fields = [] if sid is None else [_text('"id":"', sid, '"')]
    if rank is not None:
        fields.append(_text('"rank":"', rank, '"'))
    return _text("{", _joined([*fields, _text('"mainsnak":{', snak, "}")]), "}")


def _item(target: Column | str) -> Column:
    return _text('{"type":"wikibase-entityid","value":{"id":"', target, '"}}')


def _string(text: Column) -> Column:
    return _text('{"type":"string","value":"', text, '"}')


def _time(y: Column, m: Column, d: Column, p: Column) -> Column:
    at = F.format_string("+%04d-%02d-%02dT00:00:00Z", y.cast("int"), m.cast("int"), d.cast("int"))
    return _text('{"type":"time","value":{"time":"', at, '","precision":', p, "}}")


def _when(cond: Column, claim: Column) -> Column:
    return F.when(cond, claim)


def _line(wid: Column, name: Column, k: Column, claims: dict[str, list[Column]],
          sites: list[Column] | None = None) -> Column:
    def entry(lang: str, text: Column) -> Column:
        return _text(f'"{lang}":{{"language":"{lang}","value":"', text, '"}')

    labels = _joined([
        F.when(k % 4 == 0, entry("fr", _text("fr ", name))).when(k % 4 == 2, entry("fr", name)),
        F.when(k % 4 == 1, entry("de", _text("de ", name))),
        F.when(k % 4 == 0, entry("mul", name)),
        F.when(k % 2 == 1, entry("en", name)),
        F.when(k % 4 == 2, entry("es", name)),
    ])
    def braces(body: Column) -> Column:
        return _text("{", body, "}")

    props = [_text(f'"{p}":[', _joined(items), "]") for p, items in claims.items()]
    line = _text(
        '{"id":"', wid, '","type":"item","labels":',
        F.when(k % 20 != 19, braces(labels)).otherwise("[]"),
        ',"descriptions":', F.when(k % 3 == 0, braces(entry("en", _text("about ", name)))).otherwise("[]"),
        ',"sitelinks":', braces(_joined(sites)) if sites else "[]",
        ',"claims":', braces(_joined(props)), "},",
    )
    # a lambda's body is evaluated as a tree, not made into one method too long to be compiled
    return once(F.lit(0), lambda _: line)


def _lines(*args) -> Column:
    """A row's line through a generator, past which no filter is pushed: it is made once."""
    return F.explode(F.array(_line(*args))).alias("value")


def _edge(child: Column, relation: str, parent: Column, k: Column) -> Column:
    rank = F.element_at(
        F.array(F.lit("preferred"), F.lit("deprecated"), F.lit(None).cast("string"), F.lit("normal"),
                F.lit("normal")),
        (k % 5 + 1).cast("int"),
    )
    sid = F.when(k % 23 != 1, _text(child, f"${relation}$", parent))
    return _claim(_item(parent), sid, rank)


def _id(prefix: str, k: Column) -> Column:
    return _text(prefix, k.cast("long"))


def _parts(c: Catalog) -> DataFrame:
    k = F.col("p_partkey")
    wid = _id("P", k)
    parent = F.floor((k - 1) / 3).cast("long")
    last = c.table("part").agg(F.max("p_partkey")).scalar()
    return c.table("part").withColumn("last", last).select(_lines(wid, F.col("p_name"), k, {
        "P279": [
            _when(k > 0, _edge(wid, "P279", _id("P", parent), k)),
            _when(k == 1, _edge(wid, "P279", _id("P", F.col("last")), F.lit(1))),
            _when(k % 4 == 1, _claim(_item(_id("P", k * 7 % 50)), _text(wid, "$x"))),
        ],
        "P31": [
            _when(F.col("p_size") % 3 == 0, _edge(wid, "P31", _id("P", k % 40), k)),
            _when(k % 8 == 3, _claim(None, _text(wid, "$n"))),
        ],
    }))


def _customers(c: Catalog) -> DataFrame:
    k = F.col("c_custkey")
    wid, name = _id("C", k), F.col("c_name")
    office = F.col("o_orderkey") % 3
    terms = c.read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        *[F.min(F.when(office == i, F.col("o_orderkey"))).alias(f"t{i}") for i in range(3)]
    )
    y, m, d, p = 1930 + k % 60, 1 + k % 12, 1 + k % 28, 9 + k % 3
    m0, d0 = F.when(p >= 10, m).otherwise(0), F.when(p == 11, d).otherwise(0)
    zero = F.lit(0)

    def held(i: int) -> Column:
        t = F.col(f"t{i}")
        rank = F.when(t % 9 == 8, "deprecated").otherwise("normal")
        return _when(t.isNotNull(), _claim(_item(f"P{i}"), _text("C", t, "$p"), rank))

    def site(key: Column | str, title: Column) -> Column:
        return _text('"', key, '":{"title":"', title, '"}')

    plain = F.replace(name, F.lit("#"), F.lit(" "))
    sites = [
        site(_text(_id("w", k % 7), "wiki"), plain),
        F.when(k % 2 == 0, site(_text(_id("w", (k + 1) % 7), "wiki"),
                                F.replace(name, F.lit("#"), F.lit(" no ")))),
        F.when(k % 3 == 0, site("w9wiki", name)),
        F.when(k % 4 == 0, site("commonswiki", name)),
        F.when(k % 4 == 1, site("simplewiki", name)),
        F.when(k % 5 == 1, site("w1wikiquote", name)),
    ]
    human = F.when(k % 6 == 5, _item("Q43229")).otherwise(_item("Q5"))
    trade = F.when(k % 2 == 0, _item("Q82955")).otherwise(_item("Q1"))
    people = c.table("customer").join(terms, "c_custkey", "left")
    parts = c.parts("customer")  # adaptive execution joins small shuffles to few tasks
    return people.repartition(parts).select(_lines(wid, name, k, {
        "P31": [_claim(human, _text(wid, "$h"))],
        "P106": [_claim(trade, _text(wid, "$o"))],
        "P39": [held(i) for i in range(3)],
        "P569": [
            _claim(_time(y - F.when(k % 10 == 3, 60).otherwise(0), m0, d0, p), _text(wid, "$b")),
            _when(k % 8 == 0, _claim(_time(F.lit(1961), zero, zero, F.lit(9)), _text(wid, "$c"), "preferred")),
        ],
        "P570": [_when(k % 4 == 0, _claim(_time(2015 + k % 9, m0, d0, p), _text(wid, "$d")))],
        "P27": [_when(k % 3 != 0, _claim(_item(_id("N", F.col("c_nationkey"))), _text(wid, "$z")))],
        "P19": [_claim(_item(_id("S", k % 20)), _text(wid, "$l"))],
    }, sites))


def _suppliers(c: Catalog) -> DataFrame:
    k = F.col("s_suppkey")
    wid = _id("S", k)
    return c.table("supplier").select(_lines(wid, F.col("s_name"), k, {
        "P31": [_edge(wid, "P31", _id("N", F.col("s_nationkey")), k)],
        "P131": [_when(k % 2 == 0, _edge(wid, "P131", _id("R", k % 5), k))],
    }))


def _nations(c: Catalog) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    wid = _id("N", k)
    code = F.when(k % 5 != 0, _string(_id("n", k)))
    return c.table("nation").select(_lines(wid, F.col("n_name"), k, {
        "P17": [_edge(wid, "P17", _id("R", F.col("n_regionkey")), k)],
        "P37": [_edge(wid, "P37", _id("L", k % 7), k)],
        "P297": [
            _claim(code, _text(wid, "$i")),
            _when(k % 2 == 0, _claim(_string(_id("alt", k)), _text(wid, "$j"))),
        ],
    }))


def _languages_and_editions(c: Catalog) -> DataFrame:
    k = F.col("k")
    numbers = c.table("nation").select((F.col("n_nationkey") % 7).cast("long").alias("k")).distinct()
    lang, edition = _id("L", k), _id("W", k)
    site = _text("https://w", k, ".wikipedia.org/")
    kind = F.when(k == 6, _item("Q210588")).otherwise(_item("Q10876391"))
    first = F.when(k != 5, _string(site))
    lines = F.array(
        _line(lang, _text("Language ", k), k, {
            "P218": [_claim(_string(_id("l", k)), _text(lang, "$1"))],
            "P220": [_claim(_string(_id("lx", k)), _text(lang, "$3"), None)],
        }),
        _line(edition, _text("Edition ", k), k, {
            "P407": [
                _edge(edition, "P407", lang, k),
                _when(k == 3, _edge(edition, "P407", F.lit("L0"), F.lit(3))),
            ],
            "P31": [_claim(kind, _text(edition, "$31"))],
            "P856": [_claim(first, _text(edition, "$w")), _claim(_string(site), _text(edition, "$v"))],
        }),
    )
    return numbers.select(F.explode(lines).alias("value"))


def _regions_and_noise(c: Catalog) -> DataFrame:
    k = F.col("r_regionkey").cast("long")
    wid = _id("R", k)
    noise = [F.lit(t) for t in (
        "[", "]", "   ", '{"id":"broken', '{"labels":{}},', '{"id":"","labels":{}},',
    )]
    return c.table("region").select(
        F.explode(F.array(_line(wid, F.col("r_name"), k, {"P31": []}), *noise)).alias("value")
    )


def dump_lines(c: Catalog) -> DataFrame:
    """One line per entity with a trailing comma, and lines that are no entity at all."""
    kinds = (_parts, _customers, _suppliers, _nations, _languages_and_editions, _regions_and_noise)
    return reduce(DataFrame.union, [kind(c) for kind in kinds])
