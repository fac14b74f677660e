"""License scan: Dice coefficient over word bigrams against templates, in built-in expressions.

A text is compared in units: its lines, its paragraphs (between blank lines) and the whole. A unit
is normalised to lower-case words of a-z and 0-9; its set of word bigrams A is compared with each
template's set B by 2 |A and B| / (|A| + |B|). A Dice of d or more needs |A| between
d / (2 - d) |B| and (2 - d) / d |B|, so most templates are dropped by the size alone, before any
bigram is compared. A template that no unit reaches is looked for in all runs of as many words as it
has that begin with a bigram of it, so a notice within a longer line, a comment or over several
paragraphs is found; texts that share too few bigrams with it are left out before. The templates are a
fixed list within the expression: texts are read once, nothing is joined or shuffled.

Defined results: null and empty texts, and units of fewer than two words, match nothing; a template
counts once a document however many units match it, with its best coefficient, and not at all where
another template's match explains it (see explained_by), so a notice is one licence and not its
whole family; licences are listed by template name; repeated rows each get their own row; columns beyond those named are
ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction, including '
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies "
    "or substantial portions of the Software."
)
_MIT_WARRANTY = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
    "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
    "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
    "OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission."
)
_BSD_WARRANTY = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Fixed texts: notices as they stand in documents and source files.
TEMPLATES = {
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of "
    "the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of "
    "the License, or (at your option) any later version.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
    "except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
    "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
    "permissions and limitations under the License.",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": _BSD + _BSD_WARRANTY,
    "bsd-3-clause": _BSD + _BSD_THIRD + _BSD_WARRANTY,
    "bsd-short": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
    "License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
    "License.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the "
    "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, "
    "or (at your option) any later version.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
    "or (at your option) any later version.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
    "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
    "copies.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the "
    "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
    "License, or (at your option) any later version.",
    "mit": _MIT,
    "mit-full": _MIT + _MIT_WARRANTY,
    "mit-short": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
    "the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
    "modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
    "binary, for any purpose, commercial or non-commercial, and by any means.",
}


#: How much better than a look-alike's text a match must be to count beside the look-alike's.
EXPLAINED = 0.03
#: Share of a template's bigrams within another that make it a part of that, and how much less the other
#: may match.
WITHIN = 0.95
PART_LAG = 0.05


def template_bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bigrams(unit: Column) -> Column:
    """The set of word bigrams of a unit."""
    return F.array_distinct(bigram_list(unit))


def bigram_list(unit: Column) -> Column:
    """The word bigrams of a unit in order."""
    plain = F.regexp_replace(F.translate(unit, UPPER, LOWER), "[^a-z0-9]+", " ")

    def pairs(words: Column) -> Column:
        n = F.size(words)
        pair = F.transform(
            F.slice(words, F.lit(1), n - 1),
            lambda word, at: F.concat_ws(" ", word, F.get(words, at + 1)),
        )
        none = F.array().cast("array<string>")
        return F.when(n >= 2, pair).otherwise(none)

    words = F.split(F.trim(plain), " ")
    return F.transform(F.array(words), pairs)[0]


def units(text: Column) -> Column:
    lines = F.split(text, "\n", -1)
    paragraphs = F.split(text, r"\n[ \t]*\n", -1)
    return F.array_distinct(F.concat(lines, paragraphs, F.array(text)))


def dice(grams: Column, template: list[str], threshold: float) -> Column:
    """The best coefficient of any unit with the template, 0 where sizes rule all out."""
    size = len(template)
    low, high = threshold / (2 - threshold) * size, (2 - threshold) / threshold * size
    fixed = F.array(*map(F.lit, template))

    def best(so_far: Column, gram: Column) -> Column:
        n = F.size(gram)
        both = F.size(F.array_intersect(gram, fixed))
        return F.greatest(so_far, F.when(n.between(low, high), 2.0 * both / (n + size)).otherwise(0.0))

    return F.aggregate(grams, F.lit(0.0), best)


def best_run(text: Column, n_words: int, template: list[str], threshold: float) -> Column:
    """The best coefficient of any run of so many words that begins with a bigram of the template."""
    size, width = len(template), n_words - 1
    least = math.ceil(threshold / (2 - threshold) * size - 1e-9)
    fixed = F.array(*map(F.lit, template))

    def best(pairs: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(pairs)), lambda at: F.array_contains(fixed, F.get(pairs, at - 1)))

        def of_places(places: Column) -> Column:
            # Runs with fewer of the template's bigrams than any match has are left out.
            ends = F.transform(places, lambda at, k: F.struct(at.alias("at"), F.get(places, k + least - 1).alias("end")))
            starts = F.filter(ends, lambda x: x["end"] - x["at"] < width)

            def better(so_far: Column, x: Column) -> Column:
                gram = F.transform(F.array(F.array_distinct(F.slice(pairs, x["at"], F.lit(width)))), lambda g: (
                    2.0 * F.size(F.array_intersect(g, fixed)) / (F.size(g) + size)
                ))[0]
                return F.greatest(so_far, gram)

            return F.aggregate(starts, F.lit(0.0), better)

        return F.transform(F.array(places), of_places)[0]

    return F.transform(F.array(bigram_list(text)), best)[0]


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    templates: dict[str, str] | None = None,
) -> DataFrame:
    """(id, licenses): structs of template name and coefficient, those of at least the threshold,
    by name."""
    texts_of = templates or TEMPLATES
    known = {name: template_bigrams(t) for name, t in sorted(texts_of.items())}
    none = F.array().cast("array<struct<template:string,dice:double>>")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    grams = texts.select(
        "id", "text", F.filter(F.transform(units(F.col("text")), bigrams), lambda g: F.size(g) > 0).alias("grams")
    )
    # The whole text has all bigrams of its units; those that any template has:
    whole = F.aggregate("grams", F.array().cast("array<string>"), lambda a, g: F.when(F.size(g) > F.size(a), g).otherwise(a))
    every = F.array(*map(F.lit, sorted({g for t in known.values() for g in t}))).cast("array<string>")
    grams = grams.withColumn("common", F.array_intersect(whole, every))

    def coefficient(name: str, template: list[str]) -> Column:
        of_unit = F.col(f"`unit_{name}`")
        least = threshold / (2 - threshold) * len(template)
        if not template:
            return of_unit
        n_words = len(re.findall("[a-z0-9]+", texts_of[name].lower()))
        both = F.when(F.size("common") >= least - 1e-9, F.size(F.array_intersect("common", F.array(*map(F.lit, template))))).otherwise(0)
        looked = (of_unit < threshold) & (both >= least - 1e-9)
        return F.when(looked, best_run(F.col("text"), n_words, template, threshold)).otherwise(of_unit)

    grams = grams.select("*", *(dice(F.col("grams"), t, threshold).alias(f"unit_{n}") for n, t in known.items()))
    scored = F.array(
        *(
            F.struct(F.lit(name).alias("template"), coefficient(name, template).alias("dice"))
            for name, template in known.items()
        )
    )
    matched = F.filter(scored, lambda s: s["dice"] >= threshold) if known else none
    found = grams.select("id", matched.alias("matched"))
    rules = explained_by(known, threshold)
    kept = F.filter("matched", lambda s: ~_explained(s, F.col("matched"), rules)) if rules else F.col("matched")
    return found.select(F.col("id").alias(id_col), kept.alias("licenses"))


def explained_by(known: dict[str, list[str]], threshold: float) -> list[tuple[str, str, float, float]]:
    """(s, t, most, lag): a match with s stands for a text of t, if t matches too, s's coefficient is at most
    ``most``, and t's is higher by more than ``lag``.

    Templates alike (a family's members): a text of t gives s the coefficient of the two templates, so a
    match that is no better tells nothing more than t's. Templates within larger ones: a text of t holds
    one of s, so s's may be anything; t's may be a little lower, as it is the longer.
    """
    out = []
    for s, own in known.items():
        for t, other in known.items():
            if s == t or not own or not other:
                continue
            both = len(set(own) & set(other))
            alike = 2.0 * both / (len(own) + len(other))
            if alike >= threshold - EXPLAINED:
                out.append((s, t, alike + EXPLAINED, 0.0))
            elif both >= WITHIN * len(own) and len(other) > len(own):
                out.append((s, t, 1.0, -PART_LAG))
    return out


def _explained(s: Column, matched: Column, rules: list[tuple[str, str, float, float]]) -> Column:
    table = F.array(*(
        F.struct(*(F.lit(v).alias(k) for k, v in zip(("s", "t", "most", "lag"), rule, strict=True))) for rule in rules
    ))
    own = F.filter(table, lambda r: (r["s"] == s["template"]) & (s["dice"] <= r["most"]))
    return F.exists(
        own, lambda r: F.exists(matched, lambda t: (t["template"] == r["t"]) & (t["dice"] - s["dice"] > r["lag"]))
    )
