"""Column functions over page markup and wikitext."""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from kbcurate.functions.once import once

# Elements whose text is not page text.
UNREAD_ELEMENTS = ["script", "style", "template", "rt", "rp"]

# References decoded first because they are most of those found.
FREQUENT = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " "}

# Named references come from the standard library's HTML tables; some need no semicolon.
_NAMED = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
_BARE = "|".join(sorted((k for k in html.entities.html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))


# What counts as whitespace in page text (as a pattern class).
SPACES = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def collapse(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, f"[{SPACES}]+", " "))


def _decoded(name: Column, table: Column) -> Column:
    """Text of one reference name such as ``amp``, ``#233`` or ``#xe9``; null if unknown."""
    code = F.when(
        name.rlike("^#[xX][0-9A-Fa-f]{1,6}$"), F.conv(F.substr(name, F.lit(3)), 16, 10)
    ).when(name.rlike("^#[0-9]{1,7}$"), F.substr(name, F.lit(2))).try_cast("int")
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(name == "amp", "&").when(
        code.between(1, 1114111) & ~code.between(55296, 57343), char
    ).otherwise(F.try_element_at(table, name))


def unescape(text: Column, bare: bool = True) -> Column:
    """Character references decoded in one pass, inside the JVM: the text is split at ``&`` and
    each piece's reference looked up. Frequent names skip the table. As in HTML, some references need no
    semicolon; without ``bare`` those are left as they stand."""
    fast = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), FREQUENT.items(), text)
    table = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>")
    pieces = F.split(fast, "&")

    def piece(p: Column, i: Column) -> Column:
        name = F.regexp_extract(p, "^(#?[0-9A-Za-z]{1,32});", 1)
        rest = F.substr(p, F.length(name) + 2)
        decoded = F.when(name != "", _decoded(name, table))
        out = F.when(i == 0, p).when(decoded.isNotNull(), F.concat(decoded, rest))
        if bare:
            begin = F.regexp_extract(p, f"^(#[xX][0-9A-Fa-f]{{1,6}}|#[0-9]{{1,7}}|{_BARE})", 1)
            short = F.when(begin != "", _decoded(begin, table))
            out = out.when(short.isNotNull(), F.concat(short, F.substr(p, F.length(begin) + 1)))
        return out.otherwise(F.concat(F.lit("&"), p))

    return F.when(
        fast.contains("&"), F.array_join(F.transform(pieces, piece), "")
    ).otherwise(fast)


def _without(markup: Column, elements: list[str], mark: str) -> Column:
    """Markup with comments, declarations and unread elements replaced by ``mark``."""
    names = "|".join(elements)
    body = F.regexp_replace(markup, r"(?s)<!--.*?-->", mark)
    body = F.regexp_replace(body, rf"(?is)<({names})\b[^>]*>.*?(?:</\1\s*>|\z)", mark)
    return F.regexp_replace(body, r"(?s)<[!?][^>]*>", mark)


# a tag ends at the first > outside quotes; with quotes that do not pair up, at the first >
TAG = r"""(?s)</?[A-Za-z](?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>"""


def page_text(markup: Column, bare: bool = True) -> Column:
    """Readable text of a page: tags become spaces, references are decoded (see :func:`unescape` for
    ``bare``), whitespace is collapsed."""
    body = F.regexp_replace(_without(markup, UNREAD_ELEMENTS, " "), TAG, " ")
    return collapse(unescape(body, bare))


BOUNDARY = "\u0001"


def quote_stream(markup: Column) -> Column:
    """Lower-case page text for quote search: whitespace runs become one space, and a mark stands
    where an element begins or ends between two characters without space."""
    body = F.regexp_replace(
        _without(markup, ["script", "style", "noscript"], BOUNDARY), TAG, BOUNDARY
    )
    text = unescape(body)
    text = F.regexp_replace(text, f"{BOUNDARY}*[{SPACES}][{SPACES}{BOUNDARY}]*", " ")
    text = F.regexp_replace(text, f"{BOUNDARY}+", BOUNDARY)
    return F.lower(F.btrim(text, F.lit(f" {BOUNDARY}")))


def needle(quote: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(quote, f"[{SPACES}]+", " ")))


def letters(text: Column) -> Column:
    """Text without spaces and marks; a quote's letters are in a page's if the quote is."""
    return F.translate(text, f" {BOUNDARY}", "")


def _gaps(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the letters, and what stands before each: 0 nothing, 1 a space, 2 a mark."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    at = np.flatnonzero((codes != 32) & (codes != 1))
    before = codes[np.maximum(at - 1, 0)]
    gaps = np.where(before == 32, 1, np.where(before == 1, 2, 0))
    return at, gaps


def find_quotes(stream: str, quotes: list[str]) -> list[tuple[int, int]]:
    """(hits, 1-based place of the first) of each needle in a quote stream. A mark matches a space of
    a needle or nothing; hits of one needle do not overlap. The stream is taken apart once, and
    only if the letters of some needle occur in it."""
    letters_in = stream.replace(" ", "").replace(BOUNDARY, "")
    at = gaps = None
    out = []
    for quote in quotes:
        wanted = quote.replace(" ", "")
        hits, first = 0, 0
        o = letters_in.find(wanted) if wanted else -1
        if o >= 0:
            _, needed = _gaps(quote)
            if at is None:
                at, gaps = _gaps(stream)
        while o >= 0:
            inside = gaps[o + 1:o + len(wanted)]
            if ((inside == 2) | (inside == needed[1:])).all():
                hits += 1
                first = first or int(at[o]) + 1
                o = letters_in.find(wanted, o + len(wanted))
            else:
                o = letters_in.find(wanted, o + 1)
        out.append((hits, first))
    return out


def find_quote(stream: str, quote: str) -> tuple[int, int]:
    """:func:`find_quotes` of one needle."""
    return find_quotes(stream, [quote])[0]


def quote_hits() -> Callable[[Column, Column], Column]:
    """Vectorised :func:`find_quotes`: ``array<struct<hits,first_at>>`` of (stream, needles)."""

    @F.pandas_udf("array<struct<hits:long,first_at:long>>")
    def search(streams: pd.Series, needles: pd.Series) -> pd.Series:
        return pd.Series([
            [{"hits": h, "first_at": f} for h, f in find_quotes(s, list(q))] for s, q in zip(streams, needles)
        ])

    return search


def permanent_url(markup: Column) -> Column:
    """Address of the first link inside the element ``t-permalink``; null without one, or if that
    link has no address."""
    inside = F.regexp_extract(
        markup, r"""(?is)<([a-z][a-z0-9]*)\b[^>]*\bid\s*=\s*["']?t-permalink["'\s>][^<]*(.*?)</\1\s*>""", 2
    )
    link = F.regexp_extract(inside, r"""(?is)<a\b((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", 1)
    pattern = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    href = F.concat(F.regexp_extract(link, pattern, 1), F.regexp_extract(link, pattern, 2))
    return F.nullif(unescape(href), F.lit(""))


# --- wikitext -------------------------------------------------------------------------------


def infobox(wikitext: Column) -> Column:
    """Text of the first infobox template, whatever templates nest in it; null if it is not closed.

    The text from its start is split at double braces, and a running depth finds where it ends.
    """
    start = F.regexp_instr(wikitext, F.lit(r"(?i)\{\{\s*infobox"))
    text = once(start, lambda at: F.when(at > 0, F.substr(wikitext, at)))
    found = F.regexp_extract_all(text, F.lit(r"(?s)(\{\{|\}\}|(?:[^{}]++|\{(?!\{)|\}(?!\}))++)"), 1)
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, part: Column) -> Column:
        depth = s["depth"] + F.when(part == "{{", 1).when(part == "}}", -1).otherwise(0)
        at = s["at"] + 1
        end = F.when(s["end"] > 0, s["end"]).when((part == "}}") & (depth == 0), at).otherwise(0)
        return F.struct(depth.alias("depth"), at.alias("at"), end.alias("end"))

    def body(parts: Column, end: Column) -> Column:
        inside = F.array_join(F.slice(parts, F.lit(2), F.greatest(end - 2, F.lit(0))), "")
        return once(
            F.regexp_replace(inside, r"(?i)^\s*infobox", ""), lambda box: F.when((end > 0) & (box != ""), box)
        )

    return once(found, lambda parts: once(F.aggregate(parts, zero, step)["end"], lambda end: body(parts, end)))


# comments whole, brackets of templates and links, bars, and what lies between
_MARKS = r"(?s)(<!--.*?-->|\{\{|\}\}|\[\[|\]\]|\||[^{}\[\]|<]++|.)"
_BAR = "\u0002"


def _fields(box: Column) -> Column:
    """Fields of a template's text: it is split at the bars outside of templates, links and comments,
    however deep they nest, by a running depth of their brackets."""
    parts = F.regexp_extract_all(box, F.lit(_MARKS), 1)
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(s: Column, part: Column) -> Column:
        opened = part.isin("{{", "[[").cast("int") - part.isin("}}", "]]").cast("int")
        piece = F.when((part == "|") & (s["depth"] == 0), _BAR).otherwise(part)
        return F.struct(
            F.greatest(s["depth"] + opened, F.lit(0)).alias("depth"), F.concat(s["out"], piece).alias("out")
        )

    return F.split(F.aggregate(parts, zero, step)["out"], _BAR)


def _value(fields: Column, name: str) -> Column:
    """Value of the first field of a name, in any case; null without one or if it is blank."""
    first = F.get(F.filter(fields, lambda f: f.rlike(rf"(?i)^\s*{name}\s*=")), F.lit(0))
    raw = F.regexp_replace(first, r"(?s)^[^=]*=", "")
    return once(F.btrim(raw, F.lit(" \t\r\n")), lambda value: F.when(value != "", value))


def _field(box: Column, name: str) -> Column:
    return _value(_fields(box), name)


def _shown_date(raw: Column) -> Column:
    def shown(inside: Column) -> Column:
        parts = once(F.split(inside, r"\|"), lambda p: F.slice(p, F.lit(2), F.size(p)))
        args = F.filter(parts, lambda a: ~a.contains("="))
        args = F.transform(args, lambda a: F.btrim(a, F.lit(" \t\r\n")))
        three = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.coalesce(F.get(args, i), F.lit("")))
        full = once(three, lambda t: F.when(F.forall(t, lambda a: a != ""), F.array_join(t, " ")))
        return F.when(inside != "", full).otherwise(raw)

    return once(F.regexp_extract(raw, r"(?s)\{\{([^{}]*)\}\}", 1), shown)


def _shown_place(raw: Column) -> Column:
    bare = F.regexp_replace(raw, r"(?s)<!--.*?-->", "")
    return F.btrim(F.regexp_replace(bare, r"\[\[(.*?)\]\]", "$1"), F.lit(" \t\r\n"))


def birth_date(box: Column) -> Column:
    """``day month year`` of a dated template (its arguments 1, 2 and 3), else the raw value."""
    return once(_field(box, "birth_date"), _shown_date)


def birth_date_parsed(text: Column) -> Column:
    return F.try_to_date(text, "d M yyyy")


def birth_place(box: Column) -> Column:
    """Birth place without comments and link brackets."""
    return _shown_place(_field(box, "birth_place"))


def births(wikitext: Column) -> Column:
    """``struct<found,birth_date,birth_place>`` of the first infobox; its fields are split once."""

    def told(fields: Column) -> Column:
        return F.struct(
            fields.isNotNull().alias("found"), once(_value(fields, "birth_date"), _shown_date).alias("birth_date"),
            _shown_place(_value(fields, "birth_place")).alias("birth_place"),
        )

    return once(once(infobox(wikitext), _fields), told)


# --- addresses ------------------------------------------------------------------------------

# Active language editions, in the order they are tried.
ACTIVE_SITES = [
    "enwiki", "frwiki", "ruwiki", "dewiki", "eswiki", "itwiki", "plwiki", "ptwiki", "svwiki",
    "ukwiki", "viwiki", "zhwiki", "trwiki", "arwiki", "nlwiki", "idwiki", "arzwiki",
]


def page_url(site: Column, title: Column) -> Column:
    """Address of a page with its title percent-encoded; null for a site that is not active."""
    encoded = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    # url_encode is for forms: it writes a space as plus, keeps *, and encodes / and ~
    for form, path in [("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")]:
        encoded = F.replace(encoded, F.lit(form), F.lit(path))
    return F.when(
        site.isin(ACTIVE_SITES),
        F.concat(F.lit("https://"), F.replace(site, F.lit("wiki"), F.lit("")),
                 F.lit(".wikipedia.org/wiki/"), encoded),
    )
