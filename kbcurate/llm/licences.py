"""Licence scan: lines, whole texts and passages against licence templates by the Dice coefficient
of their word bigrams. Only DataFrame functions, one pass, no shuffle.

Text is normalised to lower-case words of letters and digits. With n and m distinct bigrams the
coefficient is at most 2 min(n, m) / (n + m), so only templates of a size within
``t / (2 - t)`` of a segment's are compared with it, and lines beyond all templates' sizes are
dropped before their bigrams are made.

A passage lies anywhere in the lines that match nothing themselves, read as one text, unless the
whole text matches. From each bigram of a template, the window of up to ``n (2 - t) / t`` bigrams with the
highest coefficient counts; matching windows that share a bigram are one passage. A match shares at
least ``n t / (2 - t)`` bigrams with its template, so it has one of any words in more than the other
bigrams (``anchors``); only texts with such a word are searched.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

THRESHOLD = 0.8

#: Notices and short licence texts as they are published. Placeholders are left out.
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved."],
}

_OTHER = r"[^\p{L}\p{N}\n]+"


def _plain_bigrams(text: str) -> list[str]:
    """The bigrams of a template, in order and without repeats (ASCII texts)."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def template_rows(templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> list[tuple]:
    """(position, licence, bigrams, least and most bigrams a match can have) of each template."""
    rows = []
    for licence in sorted(templates):
        for text in templates[licence]:
            grams = _plain_bigrams(text)
            low, high = len(grams) * threshold / (2 - threshold), len(grams) * (2 - threshold) / threshold
            rows.append((len(rows), licence, grams, math.ceil(low - 1e-9), math.floor(high + 1e-9)))
    return rows


def anchors(rows: list[tuple]) -> list[str]:
    """Words of which a match of any template has one: the longest that are in too many of its bigrams to miss."""
    out = set()
    for _, _, grams, least, _ in rows:
        missed, words = set(), {w for g in grams for w in g.split()}
        for word in sorted(words, key=lambda w: (-len(w), w)):
            if len(missed) > len(grams) - least:
                break
            out.add(word)
            missed |= {g for g in grams if word in g.split()}
    return sorted(out)


def _pairs(line: Column) -> Column:
    words = F.split(line, " ")
    return F.zip_with(
        F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1),
        lambda a, b: F.concat_ws(" ", a, b),
    )


def _bigrams(line: Column) -> Column:
    return F.array_distinct(_pairs(line))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _windows(grams: Column, t: Column, threshold: float) -> Column:
    """Matching windows (s, e, score, at) of the bigrams ``grams`` (with repeats), the best from each start."""
    def place(q: Column) -> Column:
        first = F.greatest(F.lit(1), q - t["most"])
        here = F.get(grams, q - 1)
        back = F.array_position(F.reverse(F.slice(grams, first, q - first)), here).cast("int")
        # whether the template has the bigram, and where it was last before
        return F.struct(F.array_contains(t["grams"], here).alias("mine"), F.when(back > 0, q - back).otherwise(0).alias("before"))

    def from_start(places: Column, s: Column) -> Column:
        def step(x: Column, q: Column) -> Column:
            at = F.get(places, q - 1)
            new = (at["before"] < s).cast("int")
            c, d = x["c"] + new * at["mine"].cast("int"), x["d"] + new
            score = 2.0 * c / (d + t["n"])
            better = score > x["score"]
            return F.struct(
                c.alias("c"), d.alias("d"), F.when(better, score).otherwise(x["score"]).alias("score"), F.when(better, q).otherwise(x["e"]).alias("e"),
            )

        start = F.struct(F.lit(0).alias("c"), F.lit(0).alias("d"), F.lit(0.0).alias("score"), F.lit(0).alias("e"))
        return F.aggregate(
            F.sequence(s, F.least(s + t["most"] - 1, F.size(places))), start, step,
            lambda x: F.struct(s.alias("s"), x["e"].alias("e"), x["score"].alias("score"), t["at"].alias("at")),
        )

    every = F.sequence(F.lit(1), F.size(grams))
    return _let(F.transform(every, place), lambda places: F.filter(
        F.transform(F.filter(every, lambda s: F.get(places, s - 1)["mine"]), lambda s: from_start(places, s)),
        lambda w: w["score"] >= threshold,
    ))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, licence, score, n_segments) per row: the template with the highest coefficient of at
    least ``threshold`` over all lines, the whole text and passages (ties: the first in order of licence; null
    and 0.0 if none), and the number of segments that match any template.

    A null or empty text matches nothing; ids may be null or repeated (each row is scanned); extra
    columns are ignored; an empty table gives an empty result; texts are scanned whole.
    """
    rows = template_rows(templates, threshold)
    low, high = min(r[3] for r in rows), max(r[4] for r in rows)
    known = F.array(*[
        F.struct(
            F.lit(-at).alias("at"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(len(grams)).alias("n"),
            F.lit(least).alias("least"), F.lit(most).alias("most"),
        ) for at, _, grams, least, most in rows
    ])
    names = F.array(*[F.lit(r[1]) for r in rows])

    def words(x: Column) -> Column:
        return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1

    text = F.regexp_replace(F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), _OTHER, " ")
    clean = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("clean"))
    marks = F.array(*map(F.lit, anchors(rows)))

    def marked(x: Column) -> Column:
        return F.arrays_overlap(F.split(x, " "), marks)

    def best(grams: Column) -> Column:
        near = F.filter(known, lambda t: (F.size(grams) >= t["least"]) & (F.size(grams) <= t["most"]))
        return F.array_max(F.transform(near, lambda t: F.struct(
            (2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + t["n"])).alias("score"), t["at"].alias("at"),
        )))

    def judged(segment: Column) -> Column:
        """The best template of a segment; null if it is none's. A match has an anchor word; a
        segment may repeat bigrams, so its words bound them from below only."""
        hit = _let(_bigrams(segment), lambda g: _let(
            F.when((F.size(g) >= low) & (F.size(g) <= high), best(g)), lambda b: F.when(b["score"] >= threshold, b)
        ))
        return F.when((words(segment) > low) & marked(segment), hit)

    # what has no anchor word has no match of any kind
    lines = F.when(marked(F.translate("clean", "\n", " ")), F.split("clean", "\n"))
    parts = clean.select("id", F.transform(lines, lambda x: F.trim(x)).alias("lines"))
    whole = F.trim(F.regexp_replace(F.array_join("lines", " "), " +", " "))
    found = parts.select("id", F.transform("lines", lambda x: F.struct(x.alias("line"), judged(x).alias("b"))).alias("lines"),
                         F.when(F.size("lines") > 1, judged(whole)).alias("whole"))
    rest = F.trim(F.regexp_replace(F.array_join(
        F.transform(F.filter("lines", lambda x: x["b"].isNull()), lambda x: x["line"]), " "
    ), " +", " "))
    scored = found.select(
        "id", F.filter(F.concat(F.transform("lines", lambda x: x["b"]), F.array("whole")), lambda b: b.isNotNull()).alias("hits"),
        # a text that is nothing but a licence has no passages
        F.when(F.col("whole").isNull() & ((F.size("lines") > 1) | F.get("lines", F.lit(0))["b"].isNull()), rest).alias("rest"),
    )
    every = F.array(*map(F.lit, sorted({g for r in rows for g in r[2]})))
    some = F.when(marked(F.col("rest")), _let(_pairs(F.col("rest")), lambda g: _let(
        F.array_intersect(g, every), lambda held: F.flatten(F.transform(
            F.filter(known, lambda t: F.size(F.array_intersect(held, t["grams"])) >= t["least"]),
            lambda t: _windows(g, t, threshold),
        ))
    )))
    none = F.array().cast("array<struct<s:int,e:int,score:double,at:int>>")
    windows = scored.select("id", "hits", F.coalesce(some, none).alias("windows"))

    def join(x: Column, w: Column) -> Column:
        return F.struct((x["n"] + (w["s"] > x["e"]).cast("int")).alias("n"), F.greatest(x["e"], w["e"]).alias("e"))

    passages = F.aggregate(
        F.array_sort("windows"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")), join, lambda x: x["n"]
    )
    hits = F.coalesce("hits", F.array().cast("array<struct<score:double,at:int>>"))
    both = F.concat(hits, F.transform("windows", lambda w: F.struct(w["score"].alias("score"), w["at"].alias("at"))))
    top = windows.select("id", F.array_max(both).alias("top"), (F.size(hits) + passages).cast("long").alias("n_segments"))
    return top.select(
        "id", F.when(F.col("n_segments") > 0, F.get(names, -F.col("top.at"))).alias("licence"),
        F.coalesce(F.col("top.score"), F.lit(0.0)).alias("score"), "n_segments",
    )
