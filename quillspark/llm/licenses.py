"""Licence scan: windows of words against licence templates, with DataFrame functions only.

A text is normalised (A-Z lower-cased, everything but ``a-z0-9`` a space); a window of its words is the bag of its word
bigrams.  It is compared to a template by Dice's coefficient, ``2 * shared / (n + m)``, shared bigrams counted with
repeats; of each licence, the best window of the whole text counts, wherever lines and paragraphs end.

* A Dice of t or more needs ``m * t / (2 - t) <= shared`` and ``n <= m * (2 - t) / t``: a text with fewer places whose
  bigram is one of a template's is no candidate for it, and windows are no longer than that.
* The best window starts and ends with a shared bigram, as one that doesn't gets better without its end.  So windows
  are pairs of such places, and shared bigrams of all windows from one place are a running count: a place counts in a
  window if the c-th place before it with its bigram lies outside, where the template has that bigram c times.
* The templates' bigrams (``MOST`` rows at most) are broadcast; what leaves the join with them are the shared places.

Before that, a necessary condition on whole documents: if some of a template's words are in more bigrams than may be
missing, a window without all of those words can't match.  Such words (rare ones first) are found for each template,
and a document that holds none of them as a substring, in lower case, is not normalised at all.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
)

_APACHE_REST = (
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at https://mozilla.org/MPL/2.0/."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
_LGPL = (
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
    "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
)
_CC0 = (
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. "
    "This software is distributed without any warranty."
)

#: (licence, name of the template, text)
TEMPLATES: list[tuple[str, str, str]] = [
    ("Apache-2.0", "line", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", _APACHE),
    ("Apache-2.0", "notice", f"{_APACHE} {_APACHE_REST}"),
    ("MIT", "line", "Released under the MIT License."),
    ("MIT", "licensed", "This project is licensed under the MIT License."),
    ("MIT", "grant", _MIT_GRANT),
    ("MIT", "full", f"MIT License {_MIT_GRANT} {_MIT_NOTICE} {_MIT_WARRANTY}"),
    ("ISC", "grant", _ISC_GRANT),
    ("BSD", "conditions", _BSD),
    ("BSD-2-Clause", "full", f"{_BSD} 1. {_BSD_SOURCE} 2. {_BSD_BINARY} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", "full", f"{_BSD} 1. {_BSD_SOURCE} 2. {_BSD_BINARY} 3. {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", "names", _BSD_NAMES),
    ("MPL-2.0", "header", _MPL),
    ("Unlicense", "dedication", _UNLICENSE),
    ("LGPL-2.1", "header", _LGPL),
    ("CC0-1.0", "dedication", _CC0),
    ("GPL-3.0", "line", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "header", _GPL),
    ("CC-BY-NC-4.0", "line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "long", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "long", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "long", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(_UPPER, _LOWER))).split()


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def bounds(m: int, least: float) -> tuple[int, int]:
    """The least number of shared bigrams and the most bigrams of a window at a Dice of ``least`` with a template of m."""
    return max(1, math.ceil(m * least / (2 - least) - 1e-9)), math.floor(m * (2 - least) / least + 1e-9)


def key_words(least: float, templates: list[tuple[str, str, str]]) -> list[str]:
    """Words of which any text with a matching unit holds one."""
    chosen: list[str] = []
    for _, _, text in templates:
        grams = [g.split(" ") for g in bigrams_of(text)]
        if not grams:
            continue
        spare = len(grams) - math.ceil(len(grams) * least / (2 - least) - 1e-9)  # bigrams that may be missing
        # rare ones first: known keys, long words, words with digits
        for w in sorted(set(words_of(text)), key=lambda w: (w not in chosen, len(w) < 5, not any(map(str.isdigit, w)), -len(w), w)):
            if sum(any(x in chosen for x in g) for g in grams) > spare:
                break
            if w not in chosen:
                chosen.append(w)
    return chosen


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def scan(docs: DataFrame, least: float = 0.8, templates: list[tuple[str, str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, template, dice, start_word, n_words): the best window of each licence, its place and size in words.

    Of equal Dice, the template that comes first by name counts, then the earliest and the shortest window.  Words are
    those of the normalised text.  Null, empty and one-word texts match nothing.  Rows of one id are scanned one by
    one and the best of all counts; rows with a null id are one document.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be in (0, 1]")
    spark, chosen = docs.sparkSession, TEMPLATES if templates is None else templates
    listed = []
    for licence, name, text in chosen:
        grams = bigrams_of(text)
        listed += [(g, licence, name, len(grams), c, *bounds(len(grams), least)) for g, c in sorted(Counter(grams).items())]
    if len(listed) > MOST:
        raise ValueError(f"the templates have {len(listed)} bigrams; {MOST} is the bound of what is broadcast")
    rows = ", ".join(f"({_quoted(g)}, {_quoted(a)}, {_quoted(b)}, {m}, {c}, {need}, {size})" for g, a, b, m, c, need, size in listed) or "('', '', '', 0, 0, 1, 0)"
    known = F.broadcast(spark.sql(f"SELECT * FROM VALUES {rows} AS t(g, license, template, m, c, need, size)"))
    often = max((r[4] for r in listed), default=1)
    holds = F.lit(False)
    for w in key_words(least, chosen):
        holds = holds | F.contains(F.col("low"), F.lit(w))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Spark's lower() folds beyond ASCII too; it never loses an ASCII letter or digit, so no match is lost
    likely = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("row"), "text", F.lower("text").alias("low")).filter(holds)
    cut = likely.select("doc_id", "row", F.split(normalise(F.col("text")), " ").alias("w"))
    more = F.greatest(F.size("w") - 1, F.lit(0))
    grams = cut.select("doc_id", "row", F.posexplode(F.zip_with(F.slice("w", F.lit(1), more), F.slice("w", F.lit(2), more), lambda a, b: F.concat(a, F.lit(" "), b))).alias("at", "g"))
    places = grams.join(known, "g").select("doc_id", "row", "license", "template", "m", "c", "need", "size", "at", "g").distinct()  # equal rows once
    whole = Window.partitionBy("doc_id", "row", "license", "template")
    places = places.withColumn("many", F.count(F.lit(1)).over(whole)).filter("many >= need")
    same = Window.partitionBy("doc_id", "row", "license", "template", "g").orderBy("at")
    before = F.coalesce(*(F.when(F.col("c") == k, F.lag("at", k).over(same)) for k in range(1, often + 1)), F.lit(-1))
    places = places.withColumn("before", before).drop("g", "c", "need", "many")
    key = ["doc_id", "row", "license", "template"]
    start = places.select(*(F.col(k).alias(f"s_{k}") for k in key), F.col("at").alias("start"))
    pairs = places.join(start, F.col("doc_id").eqNullSafe(F.col("s_doc_id")) & (F.col("row") == F.col("s_row")) & (F.col("license") == F.col("s_license")) & (F.col("template") == F.col("s_template")) & F.col("at").between(F.col("start"), F.col("start") + F.col("size") - 1))
    running = Window.partitionBy(*key, "start").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("at") - F.col("start") + 1
    dice = pairs.withColumn("shared", F.sum((F.col("before") < F.col("start")).cast("int")).over(running)).select("doc_id", "license", "template", "start", (n + 1).alias("n_words"), (2.0 * F.col("shared") / (n + F.col("m"))).alias("dice"))
    best = F.min(F.struct((-F.col("dice")).alias("d"), "template", "start", "n_words"))
    out = dice.filter(F.col("dice") >= least).groupBy("doc_id", "license").agg(best.alias("b"))
    return out.select("doc_id", "license", "b.template", (-F.col("b.d")).alias("dice"), F.col("b.start").alias("start_word"), "b.n_words")


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan_sql(least: float = 0.8) -> str:
    """The scan in DuckDB's SQL: all windows between shared bigrams, shared ones counted anew for each."""
    rows = ", ".join("({})".format(", ".join("'" + x.replace("'", "''") + "'" for x in t)) for t in TEMPLATES)
    norm = f"trim(regexp_replace(translate(raw, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    return f"""
WITH templates(license, template, raw) AS (VALUES {rows}),
tw AS (SELECT license, template, string_split({norm}, ' ') AS w FROM templates),
tb AS (SELECT license, template, g, count(*) AS c FROM (SELECT license, template, unnest(list_zip(w[:-2], w[2:])) AS z, z[1] || ' ' || z[2] AS g FROM tw) GROUP BY ALL),
tn AS (SELECT license, template, sum(c)::DOUBLE AS m FROM tb GROUP BY ALL),
dw AS (SELECT doc_id, string_split({norm.replace("raw", "text")}, ' ') AS w FROM documents),
dg AS (SELECT doc_id, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2])) AS g, generate_subscripts(w[:-2], 1) - 1 AS pos FROM dw WHERE len(w) > 1),
hits AS (SELECT doc_id, license, template, pos, g, c, m FROM dg JOIN tb USING (g) JOIN tn USING (license, template)),
enough AS (SELECT * FROM hits QUALIFY count(*) OVER (PARTITION BY doc_id, license, template) >= m * {least} / (2 - {least}) - 1e-9),
pairs AS (SELECT s.doc_id, s.license, s.template, s.m, s.pos AS a, e.pos AS b FROM enough s JOIN enough e ON s.doc_id = e.doc_id AND s.license = e.license AND s.template = e.template AND e.pos >= s.pos AND e.pos - s.pos + 1 <= s.m * (2 - {least}) / {least} + 1e-9),
inside AS (SELECT p.doc_id, p.license, p.template, p.m, a, b, g, least(count(*), any_value(c)) AS n FROM pairs p JOIN enough h ON h.doc_id = p.doc_id AND h.license = p.license AND h.template = p.template AND h.pos BETWEEN a AND b GROUP BY ALL),
dice AS (SELECT doc_id, license, template, a, b - a + 2 AS n_words, 2.0::DOUBLE * sum(n)::DOUBLE / (b - a + 1 + m)::DOUBLE AS dice FROM inside GROUP BY doc_id, license, template, a, b, m),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, template, a, n_words) AS place FROM dice WHERE dice >= {least})
SELECT doc_id, license, template, dice, a::INT AS start_word, n_words::INT AS n_words FROM best WHERE place = 1
"""
