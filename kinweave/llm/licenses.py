"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

Scanned are each whole text, each of its lines and, for each template, the runs of as many words as
it has that start with one of its bigrams, wherever lines end; at the end of a text runs are shorter.
The coefficient is ``2 * |A and B| / (|A| + |B|)`` over sets of bigrams, so with a threshold ``t``
only templates whose size is between ``t / (2 - t)`` and ``(2 - t) / t`` times the text's can reach
it, and only runs with ``t / (2 - t)`` of the template's bigrams; others are never compared. All of
it is column expressions on the rows as they are read: no shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import id_and_text
from kinweave.llm.decontaminate import BREAKS, words


@dataclass(frozen=True)
class Template:
    licence: str
    text: str


#: Notices by which texts name their licence, and how short licences begin.
TEMPLATES = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
             "except in compliance with the License. You may obtain a copy of the License at "
             "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
             "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
             "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
             "permissions and limitations under the License."),
    Template("MIT", "Released under the MIT License."),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
             "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
             "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
             "following conditions: The above copyright notice and this permission notice shall be included in all "
             "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
             "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
             "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
             "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
             "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
             "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
             "provided that the following conditions are met: 1. Redistributions of source code must retain the above "
             "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form "
             "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
             "documentation and/or other materials provided with the distribution."),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
             "(at your option) any later version."),
    Template("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "General Public License as published by the Free Software Foundation; either version 2 of the License, or "
             "(at your option) any later version."),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
             "the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    Template("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Short licences that ``TEMPLATES`` has without their disclaimers, in full.
IN_FULL = (
    Template("ISC", f"{TEMPLATES[4].text} THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
             "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
             "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
             "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
             "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    Template("BSD-2-Clause", f"{TEMPLATES[5].text} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS "
             "IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
             "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
             "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
             "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
             "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
             "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
             "THE POSSIBILITY OF SUCH DAMAGE."),
)
THRESHOLD = 0.8
#: Bounds that only leave out work give way by this much, so that rounding never decides.
SLACK = 1e-9


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: str) -> list[str]:
    return [w for w in re.split(BREAKS, text.lower()) if w]


def bigrams_of(text: str) -> list[str]:
    """The template's distinct bigrams, normalised like the texts."""
    found = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:])})


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = (*TEMPLATES, *IN_FULL), threshold: float = THRESHOLD,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Licences that each text names or holds: ``doc_id, n_units, licences, best, score``.

    ``n_units`` counts the lines of the text, ``licences`` are those (sorted) of which some template
    reaches the threshold on the whole text, a line or a run of words, ``best`` the one with the highest
    coefficient (ties to the smaller name), ``score`` that coefficient; without one they are an empty
    list, null and 0. A null or empty text has one empty line. Repeated rows give equal results; other
    columns are not read.
    """
    prepared = [(t.licence, len(words_of(t.text)) - 1, bigrams_of(t.text)) for t in templates]
    known = sorted({gram for *_, grams in prepared for gram in grams})
    low, high = threshold / (2 - threshold) - SLACK, (2 - threshold) / threshold + SLACK
    smallest = min(len(grams) for *_, grams in prepared)
    catalogue = F.array(*(F.struct(F.lit(name).alias("licence"), F.lit(run).alias("run"), F.lit(len(grams)).alias("size"),
                                   F.lit(math.ceil(low * len(grams))).alias("least"), F.lit(grams).alias("grams"))
                          for name, run, grams in prepared))
    lines = F.split("text", "\r?\n|\r", -1)
    units = F.concat(lines, F.when(F.size(lines) > 1, F.array("text")).otherwise(F.array().cast("array<string>")))
    split = id_and_text(docs, id_column, text_column).select("doc_id", units.alias("units"))
    pairs = F.transform("units", lambda u: words(u))
    pairs = F.transform(pairs, lambda w: F.zip_with(
        F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b)))
    # Bigrams of any template first: few units have enough of them, and only those are counted out.
    shared = F.filter(F.transform(pairs, lambda g, i: F.struct(
        g.alias("all"), F.array_intersect(g, F.lit(known)).alias("known"), (i == F.size("units") - 1).alias("whole"))),
        lambda s: F.size(s["known"]) >= low * smallest)
    sized = F.transform(shared, lambda s: F.struct(
        F.size(F.array_distinct(s["all"])).alias("n"), s["known"].alias("known"), s["whole"].alias("whole"),
        F.when(s["whole"], s["all"]).alias("all")))

    def hit(shared: Column, n: Column, template: Column) -> Column:
        return F.struct((F.lit(-2.0) * shared / (n + template["size"])).alias("minus"), template["licence"].alias("licence"))

    def compare(unit: Column) -> Column:
        near = F.filter(catalogue, lambda t: (t["size"] >= low * unit["n"]) & (t["size"] <= high * unit["n"]))
        return F.filter(F.transform(near, lambda t: hit(F.size(F.array_intersect(unit["known"], t["grams"])), unit["n"], t)),
                        lambda x: x["minus"] <= -threshold)

    def runs(grams: Column, marks: Column, t: Column) -> Column:
        """The best hit of the template on a run, in an array; ``marks`` are the places of known bigrams."""
        places = F.transform(F.filter(marks, lambda m: F.array_contains(t["grams"], m["gram"])), lambda m: m["at"])
        # The run must reach as many of the template's bigrams as the threshold takes at least.
        starts = let(places, lambda own: F.filter(own, lambda at, i: F.get(own, i + t["least"] - 1) < at + t["run"]))
        scored = F.transform(starts, lambda at: let(F.slice(grams, at + 1, t["run"]), lambda run: hit(
            F.size(F.array_intersect(run, t["grams"])), F.size(F.array_distinct(run)), t)))
        return F.slice(F.array_sort(F.filter(scored, lambda x: x["minus"] <= -threshold)), 1, 1)

    def compare_runs(unit: Column) -> Column:
        held = F.filter(catalogue, lambda t: F.size(F.array_intersect(unit["known"], t["grams"])) >= t["least"])
        marks = F.filter(F.transform(unit["all"], lambda gram, i: F.struct(gram.alias("gram"), i.alias("at"))),
                         lambda m: m["gram"].isin(known))
        return let(held, lambda held: F.when(F.size(held) > 0, let(marks, lambda marks: F.flatten(
            F.transform(held, lambda t: runs(unit["all"], marks, t))))))

    none = F.array().cast("array<struct<minus: double, licence: string>>")
    hits = F.transform(sized, lambda u: F.concat(
        compare(u), F.when(u["whole"], F.coalesce(compare_runs(u), none)).otherwise(none)))
    count = F.size("units")
    scored = split.select("doc_id", F.when(count > 1, count - 1).otherwise(count).cast("long").alias("n_units"),
                          F.array_sort(F.flatten(hits)).alias("hits"))
    first = F.get("hits", F.lit(0))
    return scored.select(
        "doc_id", "n_units", F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["licence"]))).alias("licences"),
        first["licence"].alias("best"), F.coalesce(-first["minus"], F.lit(0.0)).alias("score"))
