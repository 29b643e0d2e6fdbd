"""Licence scan in DataFrame expressions only: Dice coefficient over word bigrams between windows of a text and licence templates.

Words are lower-cased runs of letters and digits; years are left out, so that notices meet their templates. A window has as many words as its template, so
a notice is found within a line, over several lines and between other text. It begins where the text shares a bigram with the template. For a coefficient t a window of
any size shares at least t / (2 - t) of the template's bigrams: this size bound prunes templates and places by their number of shared bigrams before any window is
compared, and a set of letters that touch more than the rest of every template's bigrams rules out whole texts by plain substring tests.

Siblings differ in a few words: a window must hold the template's numbers, and just the telling words (Lesser, NC, not and so on) that the template has, and "not" must not stand before it. Windows that overlap are
one place, and a place goes to the template that shares most bigrams there, at equal numbers to that of the higher coefficient, at equal coefficients to all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegrain.llm.common import BROADCAST_ROWS, materialise, scratch

THRESHOLD = 0.8
#: Words that tell a licence from its siblings.
TELLING = ("affero", "lesser", "nc", "nd", "noncommercial", "noderivatives", "noderivs", "not", "sa", "sharealike")
#: Words of which up to two may stand between a negation and the window that it denies, whose notice may have begun before it (is not yet released under ...).
LINKS = ("be", "been", "currently", "distributed", "licensed", "released", "under", "yet")
#: Words too frequent in any text to be looked for while others do.
COMMON = frozenset("about after before their there these those under which while without would other whether where".split())
#: Letters of a word that are looked for as a substring.
STEM = 5

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GPL_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
_LGPL_21 = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
)
#: Passages by which the long licences are found where their whole text stands.
_APACHE_TERMS = "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."
_GPL_2_TEXT = "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."
_GPL_3_TEXT = (
    "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--"
    "to make sure it remains free software for all its users."
)

#: Notices of two licences, which count for each.
_DUAL = "Dual licensed under MIT and Apache-2.0."
_EITHER = "Licensed under either of Apache License, Version 2.0 or MIT license at your option."

#: Licence id and a notice or passage that licence texts use.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_NOTICE),
    ("MIT", _MIT_WARRANTY),
    ("MIT", f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_WARRANTY}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE_TERMS),
    ("BSD", "Released under the BSD License."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", _BSD_GRANT),
    ("BSD", _BSD_SOURCE),
    ("BSD", _BSD_BINARY),
    ("BSD", _BSD_WARRANTY),
    ("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", _BSD_NAMES),
    ("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("ISC", _ISC),
    ("ISC", _ISC_WARRANTY),
    ("ISC", f"{_ISC} {_ISC_WARRANTY}"),
    ("Zlib", _ZLIB),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GPL.format("", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", _GPL_2_TEXT),
    ("GPL-3.0", _GPL.format("", "3")),
    ("GPL-3.0", _GPL_3_TEXT),
    ("GPL", "Released under the GNU General Public License."),
    ("GPL", _GPL_WARRANTY),
    ("LGPL-2.1", _LGPL_21),
    ("LGPL-3.0", _GPL.format("Lesser ", "3")),
    ("AGPL-3.0", _GPL.format("Affero ", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", _UNLICENSE),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    *((f"CC-{x.replace(' ', '-')}-3.0", f"Licensed under CC {x} 3.0.") for x in ("BY", "BY SA", "BY NC", "BY ND", "BY NC SA", "BY NC ND")),
    *((f"CC-{x}-3.0", f"This work is licensed under a Creative Commons {y} 3.0 Unported License.") for x, y in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivs"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivs"),
    )),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2."),
    ("EUPL-1.2", "EUROPEAN UNION PUBLIC LICENCE v. 1.2"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("MIT", _DUAL),
    ("Apache-2.0", _DUAL),
    ("MIT", _EITHER),
    ("Apache-2.0", _EITHER),
    *((x, f"license: {x}") for x in ("MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "MPL-2.0")),
    ("all-rights-reserved", "All rights reserved."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."),
    *((x, f"SPDX-License-Identifier: {x}") for x in (
        "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
        "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0",
    )),
)


def normalised(text: Column) -> Column:
    """Lower case, letters and digits only, one space between words, without years."""
    s = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " ")
    return F.trim(F.regexp_replace(s, r"(?<![A-Za-z0-9_])(?:19|20)\d\d(?![A-Za-z0-9_]) ?", ""))


def _pairs(words: Column, pair) -> Column:
    """pair(a, b) of each two neighbouring words. The lambda sees only its own pair, so the optimiser can't move work on the whole array into it."""
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.lit(1 << 30)), pair)


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    return F.array_distinct(_pairs(words, lambda a, b: F.concat(a, F.lit(" "), b)))


def least_shared(m: int, threshold: float) -> int:
    """Bigrams that a window of any size shares at least with a template of m when it reaches the threshold."""
    return int(m * threshold / (2 - threshold) - 1e-9) + 1


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """template (its number), licence, k (words), m and need (bigrams, and those a window shares at least), grams, numbers and telling words."""
    rows = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(name).alias("licence"), F.lit(text).alias("text")) for i, (name, text) in enumerate(templates)))
    base = spark.range(1, numPartitions=1).select(F.explode(rows).alias("t")).select("t.template", "t.licence", F.split(normalised(F.col("t.text")), " ").alias("words"))
    sized = base.withColumn("grams", bigrams(F.col("words"))).withColumn("m", F.size("grams"))
    need = F.floor(F.col("m") * (threshold / (2 - threshold)) - 1e-9).cast("int") + 1
    return sized.select("template", "licence", F.size("words").alias("k"), "m", need.alias("need"), "grams", F.array_distinct(F.filter("words", lambda w: w.rlike("^[0-9]+$"))).alias("numbers"), _telling(F.col("words")).alias("telling"))


def _telling(words: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w.isin(list(TELLING)))))


def anchors(templates: tuple[tuple[str, str], ...], threshold: float) -> list[str]:
    """Letters of which every window that reaches the threshold with any template holds at least one run.

    Greedy: the run that serves most templates first. A run is the beginning of a word of STEM letters or more, or else a whole shorter word, and it serves the bigrams
    that hold it anywhere; a template is served when the runs touch more bigrams than a window can lack.
    """
    open_grams = []
    for _, text in templates:
        w = _plain(text)
        grams = set(zip(w, w[1:]))
        open_grams.append([grams, len(grams) - least_shared(len(grams), threshold) + 1])
    words = {w for grams, _ in open_grams for g in grams for w in g}
    stems = {w[:STEM] for w in words if len(w) >= STEM and w not in COMMON}
    holders = {s: {w for w in words if s in w} for s in stems} | {w: {w} for w in words if len(w) < STEM}
    by_word: dict[str, list[str]] = {}
    for s, own in holders.items():
        for w in own:
            by_word.setdefault(w, []).append(s)
    chosen: list[str] = []
    while left := [x for x in open_grams if x[1] > 0]:
        served: dict[str, int] = {}
        for grams, _ in left:
            for s in {s for g in grams for w in g for s in by_word.get(w, ())}:
                served[s] = served.get(s, 0) + 1
        # each template has unchosen words while it is open, as its bigrams outnumber what it needs
        stem = min(served, key=lambda s: (len(s) < STEM, -served[s], s))
        chosen.append(stem)
        for x in left:
            hit = {g for g in x[0] if holders[stem] & set(g)}
            x[0], x[1] = x[0] - hit, x[1] - len(hit)
    return chosen


def _anchored(text: Column, templates: tuple[tuple[str, str], ...], threshold: float) -> Column:
    low, found = F.lower(text), F.lit(False)
    stems = anchors(templates, threshold)
    for s in (s for s in stems if len(s) >= STEM):
        found = found | F.contains(low, F.lit(s))
    if short := [s for s in stems if len(s) < STEM]:
        some = F.lit(False)
        for x in short:  # a plain substring test spares most texts the pattern
            some = some | F.contains(low, F.lit(x))
        found = found | some & low.rlike(r"(?<![\p{L}\p{M}\p{N}])(?:" + "|".join(short) + r")(?![\p{L}\p{M}\p{N}])")
    return found


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per document row and licence that it holds: doc_id, row_key (a hash of id and text), licence, best coefficient (dice, rounded to six places) and units (places
    that go to a template of it).

    Null and empty texts and texts of fewer than two words hold nothing. Repeated rows give one row. A place for which two licences have equal claims
    counts for each. Only doc_id and text are read, so other columns may have any names. The templates are a parameter in the plan itself (a few
    thousand bigrams), which bounds what is broadcast.
    """
    with scratch(docs.sparkSession) as write:
        wins = windows(docs, threshold, templates, write)
        return materialise(places(wins), "licences")


def windows(docs: DataFrame, threshold: float, templates: tuple[tuple[str, str], ...], write) -> DataFrame:
    """(doc_id, row_key, template, licence, start, k, both, dice) of each window that reaches the threshold with a template and has what tells it."""
    table = template_table(docs.sparkSession, templates, threshold)
    key = F.xxhash64("doc_id", "text").alias("row_key")
    held = docs.where(_anchored(F.col("text"), templates, threshold)).select("doc_id", key, F.split(normalised(F.col("text")), " ").alias("words"))
    grams = held.select("doc_id", "row_key", F.posexplode(_pairs(F.col("words"), lambda a, b: F.xxhash64(a, b))).alias("i", "h"))
    known = table.select("template", "k", "need", F.explode(F.transform("grams", lambda g: F.xxhash64(F.split_part(g, F.lit(" "), F.lit(1)), F.split_part(g, F.lit(" "), F.lit(2))))).alias("h"))
    at = F.array_sort(F.collect_set("i"))
    met = grams.join(F.broadcast(known), "h").groupBy("doc_id", "row_key", "template", "k", "need").agg(at.alias("at")).where(F.size("at") >= F.col("need"))
    # a window from a shared bigram on has room for the least number of shared ones
    full = F.filter(F.transform("at", lambda x, j: F.struct(x.alias("i"), F.get("at", j + F.col("need") - 1).alias("last"))), lambda s: s["last"] <= s["i"] + F.col("k") - 2)
    starts = met.select("doc_id", "row_key", "template", "k", F.transform(full, lambda s: s["i"]).alias("starts")).where(F.size("starts") > 0)
    per_row = write(starts.groupBy(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).agg(F.collect_list(F.struct("template", "k", "starts")).alias("found")), "starts")
    if per_row.count() <= BROADCAST_ROWS:
        per_row = F.broadcast(per_row)
    back = docs.select("doc_id", key, "text").join(per_row, F.col("row_key") == F.col("_key")).where(F.col("doc_id").eqNullSafe(F.col("_id")))
    back = back.select("doc_id", "row_key", "found", F.split(normalised(F.col("text")), " ").alias("words"))
    before = lambda s, n: F.coalesce(F.get("words", s - n), F.lit(""))
    link = lambda s, n: before(s, n).isin(list(LINKS))
    denied = lambda s: (before(s, 1) == "not") | link(s, 1) & ((before(s, 2) == "not") | link(s, 2) & (before(s, 3) == "not"))
    cut = lambda x: F.transform(F.filter(x["starts"], lambda s: ~denied(s)), lambda s: F.struct(x["template"].alias("template"), s.alias("start"), F.slice("words", s + 1, x["k"]).alias("words")))
    spread = back.select("doc_id", "row_key", F.explode(F.flatten(F.transform("found", cut))).alias("w")).select("doc_id", "row_key", "w.*")
    wide = spread.join(F.broadcast(table), "template").withColumn("_own", bigrams(F.col("words")))
    told = (F.size(F.array_except("numbers", "words")) == 0) & (_telling(F.col("words")) == F.col("telling"))
    scored = wide.where(told).withColumn("both", F.size(F.array_intersect("_own", "grams"))).withColumn("dice", 2 * F.col("both") / (F.size("_own") + F.col("m")))
    return scored.where(F.col("dice") >= threshold).select("doc_id", "row_key", "template", "licence", "start", "k", "both", "dice").distinct()


def places(wins: DataFrame) -> DataFrame:
    """windows() to (doc_id, row_key, licence, dice, units): of windows of one template that overlap the best, then of what overlaps the template with most shared bigrams."""
    row = ["doc_id", "row_key"]
    by_template = W.partitionBy(*row, "template").orderBy("start")
    runs = wins.withColumn("_run", F.sum(F.coalesce((F.col("start") >= F.lag("start").over(by_template) + F.col("k")).cast("int"), F.lit(1))).over(by_template))
    best = runs.groupBy(*row, "template", "licence", "k", "_run").agg(F.max(F.struct("both", "dice", (-F.col("start")).alias("_s"))).alias("b"))
    best = best.select(*row, "licence", "k", "b.both", "b.dice", (-F.col("b._s")).alias("start"))
    in_order = W.partitionBy(*row).orderBy("start", F.desc("k"), "licence")
    # the furthest end so far, and in its last digits the size of the window that has it
    far = F.max((F.col("start") + F.col("k")).cast("long") * 100_000 + F.col("k")).over(in_order.rowsBetween(W.unboundedPreceding, -1))
    apart = best.withColumn("_far", far).withColumn("_new", F.coalesce((2 * (F.floor(F.col("_far") / 100_000) - F.col("start")) <= F.least("k", F.col("_far") % 100_000)).cast("int"), F.lit(1)))
    placed = apart.withColumn("_place", F.sum("_new").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    won = placed.withColumn("_rank", F.rank().over(W.partitionBy(*row, "_place").orderBy(F.desc("both"), F.desc("dice")))).where("_rank = 1")
    return won.groupBy(*row, "licence").agg(F.round(F.max("dice"), 6).alias("dice"), F.countDistinct("_place").alias("units"))


def _plain(text: str) -> list[str]:
    """normalised() for the templates, which are plain ASCII."""
    words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    return [w for w in words if not (len(w) == 4 and w.isdigit() and w[:2] in ("19", "20"))]
