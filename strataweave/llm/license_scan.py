"""Operator 4: licences by TF-IDF cosine to templates, then by the nearest ancestor directory. DataFrame functions only.

Units of a file are every line, the leading block of comment lines, windows of consecutive lines, and for a licence file (by
its name) the whole text. From each line on, a window takes as many lines as a template's number of terms needs, and also one
line less if the last goes beyond it. A unit's vector has term counts times ``ln((1 + files) / (1 + files with the term)) + 1``,
with the file counts of the template terms taken over all files; a term of no template counts as one of a single file. A unit
has a template's licence if their cosine is at least ``COSINE``; the best template wins, ties go to the smaller name.
``Proprietary`` stands back if anything else fits, as free licences also say that all rights are reserved.

A licence has several templates: its notice in one sentence, its title, and its longer notice or text (``FORMS``). Short
licences are there whole; long ones (GPL, AGPL, Apache, MPL, CC) by the title, the opening passage and the usual notice, which
windows find in the full text.

A unit's cosine is at most the length of the template's vector over the terms that the unit holds (Cauchy-Schwarz). Texts,
lines and windows whose terms do not reach ``COSINE`` by that are skipped, and texts without any *signature* term, of which a
unit must have one, are not even split; this changes no result.

A licence file's licence holds for its directory. A file without a licence of its own inherits from the nearest ancestor
directory that has one. Ancestors are listed once for each directory, not for each file, and met by a join on the path.

Null and empty texts have no units; a null path is a file in the root. Rows that repeat a path are files each by itself.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.session import stage

# Licence names and the words of their usual notices.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
}
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version 3 of the "
    "License, or (at your option) any later version."
)
# Further templates of the licences, titles and longer texts.
FORMS = {
    "AGPL-3.0": (
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
        _GNU.format("Affero General Public License"),
    ),
    "Apache-2.0": (
        "Apache License",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-3-Clause": (
        "BSD 3-Clause License",
        "The 3-Clause BSD License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS,
    ),
    "CC-BY-4.0": (
        "Creative Commons Attribution 4.0 International Public License",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Creative Commons Attribution-NonCommercial 4.0 International Public License",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "GPL-3.0": (
        "GNU General Public License",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        _GNU.format("General Public License"),
    ),
    "MIT": (
        "MIT License",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": (
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
}
#: Its wording also stands in other licences.
LAST = "Proprietary"
COSINE = 0.8
_COMMENT = r"^\s*(?:[#;%*]|//|/\*|--|<!--|$)"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)\b"
_SPLIT = r"[^a-z0-9.+-]+"
_TRIM = r"^[.+-]+|[.+-]+$"
# the same for whole texts: marks beside a separator go with it; no run of marks is tried twice
_BETWEEN = r"(?:(?<![.+-])[.+-]++)?+[^a-z0-9.+-]++[.+-]*+"
_ENDS = r"^[.+-]++|(?<![.+-])[.+-]++$"


def _terms_of(text: str) -> list[str]:
    import re

    return [t for t in (re.sub(_TRIM, "", x) for x in re.split(_SPLIT, text.lower())) if t]


def terms(text):
    """Lower-case terms of a text column, repeated as they occur."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), _ENDS, ""), _BETWEEN), lambda t: t != "")


def weights(counts: dict[str, int], files: int, forms: list[tuple[str, str]]) -> list[dict[str, float]]:
    """Unit vectors of the templates."""
    out = []
    for _, text in forms:
        own: dict[str, float] = {}
        for t in _terms_of(text):
            own[t] = own.get(t, 0.0) + math.log((1 + files) / (1 + counts.get(t, 0))) + 1
        norm = math.sqrt(sum(v * v for v in own.values()))
        out.append({t: v / norm for t, v in own.items()})
    return out


def signatures(vectors: list[dict[str, float]], cosine: float = COSINE) -> set[str]:
    """Terms of which a unit must have one to reach ``cosine`` with any template."""
    found = set()
    for vector in vectors:
        rest = 1.0
        for t, v in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if rest < (cosine - 1e-9) ** 2:
                break
            found.add(t)
            rest -= v * v
    return found


def _windows(table: DataFrame, held, reach, sizes: list[int], bound: float) -> DataFrame:
    """``row, kind, place, words``: lines and windows of lines of ``table(row, text)`` that may reach the cosine."""
    lines = table.select("row", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("row", "pos", terms(F.col("line")).alias("words"))
    lines = lines.withColumn("n", F.size("words")).withColumn("reach", reach(held(F.col("words"))))
    ordered = Window.partitionBy("row").orderBy("pos")
    lines = lines.withColumn("after", F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("after") - F.col("n")).filter("n > 0")
    near = Window.partitionBy("row").orderBy("before")
    # a line is in a window of n terms if fewer than n terms come before it
    reached = [F.sum(F.col("reach")[i]).over(near.rangeBetween(0, n - 1)) >= bound for i, n in enumerate(sizes)]
    wanted = F.array_compact(F.array(*(F.when(r, F.lit(n)) for r, n in zip(reached, sizes))))
    ahead = F.collect_list(F.struct("before", "after", "words")).over(near.rangeBetween(0, max(sizes) - 1))
    seen = lines.select("row", "pos", "before", "after", wanted.alias("wanted"), ahead.alias("ahead")).filter(F.size("wanted") > 0)
    last = lambda keep: F.array_max(F.transform(F.filter("ahead", keep), lambda x: x.after))
    whole = F.transform("wanted", lambda n: last(lambda x: x.before < F.col("before") + n))
    less = F.transform("wanted", lambda n: last(lambda x: x.after <= F.col("before") + n))
    ends = F.array_distinct(F.array_compact(F.concat(F.array("after"), whole, less)))
    each = seen.select("row", "pos", "ahead", F.explode(ends).alias("end"))
    words = F.flatten(F.transform(F.filter("ahead", lambda x: x.after <= F.col("end")), lambda x: x.words))
    return each.select("row", F.lit("header").alias("kind"), F.struct("pos", "end").alias("place"), words.alias("words"))


def scan_licences(files: DataFrame, templates=None, cosine: float = COSINE) -> DataFrame:
    """``doc_id, path, license, score, found`` (header, file, inherited, none)``, license_dir`` of every row of ``files(doc_id, path, text)``.

    ``templates`` has a text or several for each licence; without it, those of ``TEMPLATES`` and ``FORMS`` are taken.
    """
    spark = files.sparkSession
    templates = templates or {name: (text, *FORMS.get(name, ())) for name, text in TEMPLATES.items()}
    forms = [(name, text) for name, texts in sorted(templates.items()) for text in ([texts] if isinstance(texts, str) else texts)]
    vocabulary = sorted({t for _, text in forms for t in _terms_of(text)})
    rows = files.select("doc_id", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))

    known = F.split(F.lit(" ".join(vocabulary)), " ")
    held = lambda words: F.array_intersect(F.array_distinct(words), known)
    seen = rows.select(F.explode(held(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    counts = {r.term: r.n for r in seen.collect()}  # one row for each template term
    total = files.count()
    vectors = weights(counts, total, forms)
    inverse = {t: math.log((1 + total) / (1 + counts.get(t, 0))) + 1 for t in vocabulary}
    signature = "|".join(t.replace(".", r"\.").replace("+", r"\+") for t in sorted(signatures(vectors, cosine)))
    may = rf"(?<![a-z0-9])(?:{signature})(?![a-z0-9])"

    # squared length of each template's vector over the held terms
    squared = json.dumps([[{"t": t, "v": v * v} for t, v in sorted(vector.items())] for vector in vectors])
    squares = F.from_json(F.lit(squared), "array<array<struct<t: string, v: double>>>")  # one constant, not thousands
    within = lambda has, s: F.aggregate(F.filter(s, lambda e: F.array_contains(has, e.t)), F.lit(0.0), lambda x, e: x + e.v)
    # the held terms go through a lambda so that they are made once, not for each template term
    reach = lambda has: F.transform(F.array(has), lambda h: F.transform(squares, lambda s: within(h, s)))[0]
    bound = (cosine - 1e-9) ** 2

    named = F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENCE_FILE)
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    likely = F.when(F.lower("text").rlike(may), F.when(F.array_max(reach(held(terms(F.col("text"))))) >= bound, F.col("text")))
    listed = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", directory.alias("dir"), named.alias("is_licence"), likely.alias("text"))
    table = stage(listed)

    texts = table.filter("text IS NOT NULL")
    split = F.split("text", "\n")
    end = F.array_position(F.transform(split, lambda x: x.rlike(_COMMENT)), False)
    block = F.when(end != 1, F.array_join(F.when(end > 1, F.slice(split, 1, (end - 1).cast("int"))).otherwise(split), "\n"))
    place = F.struct(F.lit(-1).alias("pos"), F.lit(-1).cast("long").alias("end"))
    single_units = [texts.select("row", F.lit(kind).alias("kind"), place.alias("place"), terms(unit).alias("words")).filter("words IS NOT NULL") for kind, unit in (("header", block), ("file", F.when(F.col("is_licence"), F.col("text"))))]
    units = _windows(texts, held, reach, [len(_terms_of(text)) for _, text in forms], bound).unionByName(single_units[0]).unionByName(single_units[1])

    single = math.log((1 + total) / 2) + 1
    parts = units.select("row", "place", "kind", F.explode("words").alias("term"))
    counted = parts.groupBy("row", "place", "kind", "term").agg(F.count("*").alias("tf"))
    sides = [(t, inverse[t], [vector.get(t, 0.0) for vector in vectors]) for t in vocabulary]
    template = spark.createDataFrame(sides, "term string, idf double, w array<double>")
    met = counted.join(F.broadcast(template), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(single)))
    sums = [F.sum(F.col("x") * F.coalesce(F.col("w")[i], F.lit(0.0))).alias(f"p{i}") for i in range(len(forms))]
    product = met.groupBy("row", "place", "kind").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *sums)
    scores = [
        F.struct(F.lit(n != LAST).alias("first"), (F.col(f"p{i}") / F.col("norm")).alias("score"), F.lit(-i).alias("form"), F.lit(n).alias("license")) for i, (n, _) in enumerate(forms)
    ]
    ranked = F.filter(F.array(*scores), lambda s: s.score >= cosine - 1e-12)
    best = product.select("row", "kind", F.array_max(ranked).alias("b")).filter("b IS NOT NULL")
    own = best.groupBy("row").agg(F.max(F.struct("b.first", "b.score", "b.form", "b.license", "kind")).alias("best"))
    found = stage(table.drop("text").join(own, "row", "left").select("row", "doc_id", "path", "dir", "is_licence", "best.license", "best.score", "best.kind"))

    granted = found.filter("is_licence AND license IS NOT NULL").groupBy("dir").agg(F.max(F.struct("score", "license")).alias("g"))
    granted = granted.select(F.col("dir").alias("license_dir"), F.col("g.license").alias("granted"), F.col("g.score").alias("granted_score"))
    pieces = F.split("dir", "/")
    prefixes = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda k: F.array_join(F.slice(pieces, F.lit(1), k), "/")))
    )
    ancestors = found.select("dir").distinct().select("dir", F.posexplode(prefixes).alias("depth", "license_dir"))
    nearest = ancestors.join(granted, "license_dir").groupBy("dir").agg(F.max(F.struct("depth", "license_dir", "granted", "granted_score")).alias("n"))
    out = found.join(nearest, "dir", "left")
    has = F.col("license").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("license", "n.granted").alias("license"),
        F.coalesce("score", "n.granted_score").alias("score"),
        F.when(has, F.col("kind")).when(F.col("n").isNotNull(), "inherited").otherwise("none").alias("found"),
        F.when(has, F.col("dir")).otherwise(F.col("n.license_dir")).alias("license_dir"),
    )
