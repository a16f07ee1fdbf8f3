"""Licence scan: sparse TF-IDF cosine to templates, and inheritance from the nearest directory.

1. Units. Comment marks are taken off, and a text falls into lines, the sentences of each line, paragraphs
   between blank lines, blocks of comment lines with the blank comment lines between them (a header that
   is wrapped over lines, however narrow), runs of neighbouring lines that count, and, where most of its
   words stand in paragraphs that count, the whole file. Units are formed first and tested then: one
   counts only if it has a term that some template cannot do without, terms that together make up more
   than 1 - threshold**2 of a template's squared length. A unit with none of them is below the threshold
   whatever else it says.
2. Score. Each distinct unit is scored once (one that a third of all documents share is one row): its
   terms, by 1 + log of their number and inverse document frequency over the templates, against those
   of each template; terms that no template has count in the unit's length, function words nowhere.
3. A document's licence is that of its best unit. It is a licence file if the whole file is a licence
   (scores ``file_threshold``), or if its name says so and any unit scores. Documents without a licence of their own take that of the
   nearest directory above them that holds a licence file.

Nulls: a null text has no lines; a null path has no directory and inherits nothing. Ties go to the
licence that sorts first. Repeated rows are judged alike. Very long texts are read whole. An empty
table gives no rows. Further columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import stored

# The texts of short licences and the notices and titles of long ones.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TERMS = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
_GPL = (
    "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version. "
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
    "You should have received a copy of the GNU {name} along with this {what}."
)
_FAMILY = [("GPL-3.0", "program", "General Public License", "3"), ("GPL-2.0", "program", "General Public License", "2"), ("LGPL-3.0", "library", "Lesser General Public License", "3"), ("AGPL-3.0", "program", "Affero General Public License", "3")]
_SPDX = ["Apache-2.0", "MIT", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "Unlicense", "CC-BY-4.0", "CC0-1.0", "Zlib"]
_CC = {"CC-BY-4.0": ("CC BY 4.0", "Attribution"), "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Attribution-ShareAlike"), "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Attribution-NonCommercial"), "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Attribution-NoDerivatives")}
TEMPLATES = [
    *[(x, f"SPDX-License-Identifier: {x}") for x in _SPDX],
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "Apache License"),
    ("MIT", "Released under the MIT License."),
    *[("MIT", x) for x in (_MIT, _MIT_NOTICE, _MIT_WARRANTY, f"{_MIT} {_MIT_NOTICE} {_MIT_WARRANTY}")],
    *[("ISC", x) for x in (_ISC, _ISC_WARRANTY, f"{_ISC} {_ISC_WARRANTY}")],
    *[("BSD-3-Clause", x) for x in ("Released under the BSD 3-Clause License.", "BSD 3-Clause License", _BSD_NAME, f"{_BSD} {_BSD_TERMS} {_BSD_NAME} {_BSD_WARRANTY}")],
    *[("BSD-2-Clause", x) for x in ("Released under the BSD 2-Clause License.", "BSD 2-Clause License", f"{_BSD} {_BSD_TERMS} {_BSD_WARRANTY}")],
    *[("BSD", x) for x in (_BSD, _BSD_TERMS, _BSD_WARRANTY)],
    *[(x, _GPL.format(what=what, mark=":" if n == "3" else ";", name=name, n=n)) for x, what, name, n in _FAMILY],
    *[(x, f"This work is licensed under the GNU {name}, version {n}.") for x, _, name, n in _FAMILY],
    *[(x, f"GNU {name.upper()} Version {n}") for x, _, name, n in _FAMILY],
    ("GPL", "GNU GENERAL PUBLIC LICENSE"),
    ("GPL", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    *[(x, f"Licensed under {short}.") for x, (short, _) in _CC.items()],
    *[(x, f"This work is licensed under a Creative Commons {name} 4.0 International License.") for x, (_, name) in _CC.items()],
    ("CC0-1.0", "Licensed under CC0 1.0, dedicated to the public domain."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("Proprietary", "Copyright. All rights reserved."),
]
# Function words.
FUNCTION_WORDS = frozenset(
    "a about above all also an and any are as at be been but by can could do does either for from had has have he her his how i if in into is it its may more must no nor not of on one only or other "
    "our out over shall she should so some such than that the their them then there these they this those to under up upon was way we were what when where whether which who whom will with without would you your".split()
)
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
#: What comments begin and end lines with.
COMMENT = r"(?m)^[ \t]*(?:<!--|/\*+|\*+/|\*+|//+|#+|--+|;+|%+)[ \t]?|[ \t]*(?:\*+/|-->)[ \t]*$"
#: A line that is a comment from its start; in it, what comes before the text.
COMMENT_LINE = r"^[ \t]*(?:<!--|/\*+|\*+/|\*+|//+|#+|--+|;+|%+)"
SENTENCE = r"(?<=[.;:!?])[ \t]+"
#: The weight of a term that no template has.
UNSEEN = 1.0


def template_vectors(templates=TEMPLATES) -> list[tuple[int, str, str, float, float]]:
    """(template, licence, term, inverse document frequency, weight / length)."""
    bags = [Counter(t for t in re.findall(TERM, text.lower()) if t not in FUNCTION_WORDS) for _, text in templates]
    df = Counter(t for bag in bags for t in bag)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for k, ((name, _), bag) in enumerate(zip(templates, bags)):
        weight = {t: (1 + math.log(n)) * idf[t] for t, n in bag.items()}
        length = math.sqrt(sum(w * w for w in weight.values()))
        rows += [(k, name, t, idf[t], w / length) for t, w in sorted(weight.items())]
    return rows


def needed_terms(threshold: float, rows) -> set[str]:
    """Terms such that a unit without any of them is below the threshold: of each template the longest, as these are rare elsewhere."""
    own: dict[int, list[tuple[int, float, str]]] = {}
    for k, _, term, _, part in rows:
        own.setdefault(k, []).append((-len(term), part, term))
    found = set()
    for terms in own.values():
        total = 0.0
        for _, part, term in sorted(terms):
            found.add(term)
            total += part * part
            if total > 1 - threshold * threshold + 1e-9:
                break
    return found


def any_of(terms) -> str:
    """A pattern for whole terms that tries each character once."""
    tree: dict = {}
    for term in terms:
        at = tree
        for c in term:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(node: dict) -> str:
        ways = [re.escape(c) + pattern(below) for c, below in sorted(node.items()) if c]
        if not ways:
            return ""
        inner = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return inner + ("?" if "" in node else "")

    return rf"(?<![a-z0-9])(?:{pattern(tree)})(?![a-z0-9])"


def units(text: Column, pattern: str) -> tuple[Column, Column]:
    """The distinct lines, sentences, paragraphs, comment blocks and runs of lines that may score, and the whole file if most of its words are in such paragraphs."""
    may = lambda x: F.lower(x).rlike(pattern)
    bare = lambda x: F.btrim(F.regexp_replace(x, COMMENT, ""))
    given = F.split(text, r"\r?\n|\r", -1)
    lines = F.transform(given, bare)
    some = F.filter(lines, may)
    sentences = F.filter(F.flatten(F.transform(some, lambda x: F.split(x, SENTENCE, -1))), may)
    joined = lambda ls: F.filter(F.split(F.array_join(ls, "\n"), "\n\n+", -1), may)
    paragraphs = joined(lines)
    blocks = joined(F.transform(given, lambda x: F.when(x.rlike(COMMENT_LINE), F.concat(bare(x), F.lit(" "))).otherwise("")))
    runs = joined(F.transform(lines, lambda x: F.when(may(x), x).otherwise("")))
    count = lambda x: F.regexp_count(x, F.lit(r"\S+"))
    whole = F.when(2 * count(F.array_join(paragraphs, " ")) >= count(text), text)
    plain = lambda x: F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9.]+", " "))
    return F.array_distinct(F.transform(F.concat(some, sentences, paragraphs, blocks, runs), plain)), plain(F.regexp_replace(whole, COMMENT, ""))


#: What stands for a unit's text where it is grouped and joined.
UNIT_KEY = ["u", "v"]


def with_unit_key(df: DataFrame) -> DataFrame:
    return df.withColumns({"u": F.xxhash64("unit"), "v": F.xxhash64("unit", F.lit(1))})


def scored_units(found: DataFrame, threshold: float, rows) -> DataFrame:
    """u, v, licence and score of each distinct unit (u, v, unit) that is at ``threshold`` or above."""
    table = found.sparkSession.createDataFrame(rows, "template int, licence string, term string, idf double, part double")
    idf = F.broadcast(table.select("term", "idf").distinct())  # the templates are a fixed list
    terms = found.select(*UNIT_KEY, F.explode(F.expr(f"regexp_extract_all(unit, '{TERM.replace(chr(92), chr(92) * 2)}', 0)")).alias("term")).where(~F.col("term").isin(*sorted(FUNCTION_WORDS)))
    terms = terms.groupBy(*UNIT_KEY, "term").agg(F.count("*").alias("n")).join(idf, "term", "left").withColumn("weight", (1 + F.log("n")) * F.coalesce("idf", F.lit(UNSEEN)))
    length = terms.groupBy(*UNIT_KEY).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    dot = terms.where("idf is not null").join(F.broadcast(table.select("template", "licence", "term", "part")), "term").groupBy(*UNIT_KEY, "template", "licence").agg(F.sum(F.col("weight") * F.col("part")).alias("dot"))
    best = dot.join(length, UNIT_KEY).withColumn("score", F.round(F.col("dot") / F.col("length"), 6)).where(F.col("score") >= threshold)
    return best.groupBy(*UNIT_KEY).agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b")).select(*UNIT_KEY, F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def scan(docs: DataFrame, path: Column, threshold: float = 0.7, file_threshold: float = 0.9, templates=TEMPLATES) -> DataFrame:
    """doc_id, path, licence, score, origin and licence_dir of every row.

    origin: ``file`` (a licence file), ``header`` (a part of the document), ``directory`` (inherited) or null.
    """
    rows = template_vectors(templates)
    pattern = any_of(needed_terms(threshold, rows))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.cast("string").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts, whole = units(F.col("text"), pattern)
    may = F.lower("text").rlike(pattern)
    given = given.select("doc_id", "path", F.xxhash64("text").alias("_text"), F.when(may, parts).alias("_units"), F.when(may, whole).alias("_whole"))
    given = stored(given, "licence-units")  # the texts are read once
    key = ["doc_id", "path", "_text"]
    # equal rows count once
    every = F.array_distinct(F.concat("_units", F.filter(F.array("_whole"), lambda x: x.isNotNull())))
    found = given.where("_units is not null").select(*key, F.explode(F.transform(every, lambda u: F.struct(u.alias("unit"), u.eqNullSafe(F.col("_whole")).alias("whole")))).alias("x")).select(*key, "x.*")
    found = with_unit_key(found)
    scored = stored(scored_units(found.select(*UNIT_KEY, "unit").dropDuplicates(UNIT_KEY), threshold, rows), "scored-units")
    own = found.select(*key, *UNIT_KEY, "whole").join(scored, UNIT_KEY).groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"), F.max(F.col("whole") & (F.col("score") >= file_threshold)).alias("_file"))
    known = given.select(*key).join(own.withColumnsRenamed({k: f"o{k}" for k in key}), [F.col(k).eqNullSafe(F.col(f"o{k}")) for k in key], "left")
    is_file = F.col("b").isNotNull() & (F.col("_file") | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)))
    known = known.select("doc_id", "path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"), F.when(is_file, "file").when(F.col("b").isNotNull(), "header").alias("origin"))
    held = known.where("origin = 'file' and path is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b")).select(F.col("dir").alias("licence_dir"), F.col("b.licence").alias("dir_licence"))
    steps = F.split("dir", "/")
    above = known.where("path is not null").select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("licence_dir"))
    nearest = above.join(held, "licence_dir").groupBy("dir").agg(F.max_by(F.struct("licence_dir", "dir_licence"), F.length("licence_dir")).alias("up"))
    out = known.join(nearest, "dir", "left")
    inherits = F.col("licence").isNull() & F.col("path").isNotNull() & F.col("up").isNotNull()
    return out.select("doc_id", "path", F.when(inherits, F.col("up.dir_licence")).otherwise(F.col("licence")).alias("licence"), "score", F.when(inherits, "directory").otherwise(F.col("origin")).alias("origin"), F.when(inherits, F.col("up.licence_dir")).alias("licence_dir"))
