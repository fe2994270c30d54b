"""License scans: runs of a text's words compared to licence templates by Dice over word bigrams.

Words are runs of ASCII letters and digits, lower-cased, whatever the lines, so a notice is found alone
in a line, wrapped over several, behind comment marks, or inside a longer paragraph. Dice >= t needs
|A| between |B| * t / (2 - t) and its inverse. These size bounds prune: of all runs of words within a
template's bounds only those that begin and end with one of its bigrams can be best, so runs are made
from these places alone; a place needs |B| * t / (2 - t) of them within the longest run; and texts
without any of a few word beginnings and bigrams, all of which no run at t can lack, are dropped
before they are cut to words. The best runs that don't overlap are kept, greatest Dice first, then the
earliest and the shortest.

The templates are a parameter and a fixed small table; it is broadcast because its size is the
table's below, not the data's. Defined results: null and empty texts have no match; a text of any
length is scanned whole; a row without doc_id has no result; ties go to the longer template and then
to the first name; rows that repeat doc_id and text give one result, and rows that share a doc_id but
not the text are scanned each; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table

DICE = 0.8

# Public short notices of common licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

# Licences and headers that stand whole inside documents.
FULL_TEXTS = (
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
)


def bounds(templates, dice: float) -> list[tuple[str, int, int, int, set[str]]]:
    """Name, distinct bigrams, fewest of them that a run needs, most bigrams that a run may have, and the bigrams."""
    low, high, out = dice / (2 - dice), (2 - dice) / dice, []
    for name, text in templates:
        w = re.findall("[a-z0-9]+", text.lower())
        grams = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        n = len(set(grams))
        out.append((name, n, math.ceil(n * low - 1e-9), math.floor(len(grams) * high + 1e-9), set(grams)))
    return out


def anchors(known) -> tuple[list[str], str]:
    """Beginnings of words, and a pattern of bigrams: a text with |B| * t / (2 - t) bigrams of a template has one of them, as those without are too few."""
    left = {k: (t[1] - t[2] + 1, set(t[4])) for k, t in enumerate(known)}
    begins = lambda g: {w[:n] for w in g.split() for n in range(5, len(w) + 1)}
    words, pairs = [], set()
    while left:
        gain = Counter(x for n, grams in left.values() for g in grams for x in begins(g))
        if gain:
            words.append(x := max(gain, key=lambda x: (gain[x], len(x), x)))
            left = {k: (n - sum(x in begins(g) for g in grams), {g for g in grams if x not in begins(g)}) for k, (n, grams) in left.items()}
        else:
            for n, grams in left.values():
                pairs |= set(sorted(grams, key=lambda g: (-len(g), g))[:n])
            left = {}
        left = {k: x for k, x in left.items() if x[0] > 0}
    return words, "|".join(g.replace(" ", "[^a-z0-9]+") for g in sorted(pairs))


def scan_licenses(docs: DataFrame, templates=TEMPLATES + FULL_TEXTS, dice: float = DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, first_word, last_word, shared, n_unit, n_template of the best runs of words, anywhere in the text, at dice or more. Two templates of one licence count apart."""
    known = bounds(templates, dice)
    starts = sorted({g.split()[0] for t in known for g in t[4]})
    gram = lambda w, i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1))
    word = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "[^A-Za-z0-9]+"), F.lower), lambda w: w != "")
    every = sorted({g for t in known for g in t[4]})
    at = lambda w: F.when(F.size(w) >= 2, F.filter(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.get(w, i).isin(starts) & gram(w, i).isin(every))).otherwise(F.array().cast("array<int>"))
    rare, pairs = anchors(known)

    def may(t: Column) -> Column:
        has = reduce(Column.__or__, (t.contains(w) for w in rare), F.lit(False))
        return has | t.rlike(pairs) if pairs else has

    found = docs.where(F.col(id_col).isNotNull() & let(F.lower(F.col(text_col)), may)).select(F.col(id_col).alias("doc_id"), let(word, lambda w: F.struct(w.alias("w"), at(w).alias("at"))).alias("x"))
    found = found.select("doc_id", "x.w", "x.at").where(F.size("at") >= min(t[2] for t in known))
    among = lambda grams: F.filter("at", lambda i: gram(F.col("w"), i).isin(grams))
    # The few texts with enough bigrams of any template are read once more for each template.
    wide = found.select("doc_id", "w", F.explode(F.array(*(F.struct(F.lit(k).alias("t"), among(sorted(t[4])).alias("at")) for k, t in enumerate(known)))).alias("x"))
    spec = docs.sparkSession.createDataFrame([(k, *t[:4]) for k, t in enumerate(known)], "t int, license string, n_template int, need int, longest int")
    wide = wide.select("doc_id", "w", "x.t", "x.at").join(F.broadcast(spec), "t").where(F.size("at") >= F.col("need"))
    at, need, longest, w = (F.col(c) for c in ("at", "need", "longest", "w"))
    begin = F.filter(F.sequence(F.lit(0), F.size(at) - need), lambda i: F.get(at, i + need - 1) - F.get(at, i) < longest)
    runs = wide.select("*", F.explode(begin).alias("i")).select("*", F.explode(F.filter(F.sequence(F.col("i") + need - 1, F.least(F.size(at), F.col("i") + longest) - 1), lambda j: F.get(at, j) - F.get(at, F.col("i")) < longest)).alias("j"))
    distinct = lambda places: F.size(F.array_distinct(F.transform(places, lambda p: gram(w, p))))
    a, b = F.get(at, F.col("i")), F.get(at, F.col("j"))
    runs = runs.select("doc_id", "license", "t", "n_template", a.alias("first_word"), (b + 1).alias("last_word"), distinct(F.slice(at, F.col("i") + 1, F.col("j") - F.col("i") + 1)).alias("shared"), distinct(F.sequence(a, b)).alias("n_unit"))
    runs = runs.where(F.col("shared") * 2 >= dice * (F.col("n_unit") + F.col("n_template")))
    score = (-F.col("shared") / (F.col("n_unit") + F.col("n_template"))).alias("s")
    best = runs.groupBy("doc_id", "license", "t", "n_template").agg(F.sort_array(F.collect_set(F.struct(score, "first_word", "last_word", "shared", "n_unit"))).alias("x"))
    kind = best.schema["x"].dataType
    apart = F.aggregate("x", F.array().cast(kind), lambda kept, r: F.when(F.exists(kept, lambda k: (k["first_word"] <= r["last_word"]) & (r["first_word"] <= k["last_word"])), kept).otherwise(F.concat(kept, F.array(r))))
    return best.select("doc_id", "license", "n_template", F.explode(apart).alias("r")).select("doc_id", "license", "r.first_word", "r.last_word", "r.shared", "r.n_unit", "n_template")


def op5_license_scan(spark, sf_dir) -> DataFrame:
    """doc_id, n_licenses (templates found), license, first_word, last_word, dice_ppm: of each document its best run."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ppm = F.expr("2000000 * shared div (n_unit + n_template)")
    runs = scan_licenses(docs)
    # The least of the negated numbers: greatest score, longer template, first name, then the run's own order.
    best = runs.groupBy("doc_id").agg(F.countDistinct("license", "n_template").alias("n"), F.min(F.struct((-ppm).alias("s"), -F.col("n_template"), "license", (-F.col("shared") / (F.col("n_unit") + F.col("n_template"))).alias("d"), "first_word", "last_word")).alias("top"))
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct()
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return ids.join(best, "doc_id", "left").select("doc_id", count(F.col("n")).alias("n_licenses"), F.col("top.license").alias("license"), F.col("top.first_word").cast("long").alias("first_word"), F.col("top.last_word").cast("long").alias("last_word"), count(-F.col("top.s")).alias("dice_ppm"))


def op5_sql(templates=TEMPLATES + FULL_TEXTS, dice: float = DICE) -> str:
    known = bounds(templates, dice)
    spec = ", ".join(f"({k}, '{name}', {n}, {need}, {longest}, [{', '.join(repr(g) for g in sorted(grams))}])" for k, (name, n, need, longest, grams) in enumerate(known))
    return f"""
WITH t(t, license, n_template, need, longest, grams) AS (VALUES {spec}),
g AS (SELECT t, need, longest, unnest(grams) AS gram FROM t),
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM w WHERE len(w) >= 2),
p AS (SELECT doc_id, unnest(b) AS gram, generate_subscripts(b, 1) AS i FROM b),
a AS (
  SELECT doc_id, t, need, longest, i, row_number() OVER (PARTITION BY doc_id, t ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id, t) AS n
  FROM p JOIN g ON p.gram = g.gram QUALIFY n >= need),
r AS (
  SELECT x.doc_id, x.t, x.i AS first, y.i AS last FROM a x JOIN a y
    ON x.doc_id = y.doc_id AND x.t = y.t AND y.i - x.i < x.longest AND y.k >= x.k + x.need - 1),
c AS (
  SELECT r.doc_id, t.t, license, n_template, first, last, len(list_distinct(b[first:last])) AS n_unit,
    len(list_intersect(list_distinct(b[first:last]), grams)) AS shared
  FROM r JOIN t ON r.t = t.t JOIN b ON r.doc_id = b.doc_id),
s AS (
  SELECT *, shared / (n_unit + n_template)::DOUBLE AS d FROM c WHERE shared * 2 >= {dice}::DOUBLE * (n_unit + n_template)),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, t ORDER BY d DESC, first, last) = 1),
f AS (
  SELECT *, 2000000 * shared // (n_unit + n_template) AS ppm, count(*) OVER (PARTITION BY doc_id) AS n_licenses FROM o
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ppm DESC, n_template DESC, license, d DESC, first, last) = 1)
SELECT d.doc_id, coalesce(f.n_licenses, 0)::BIGINT AS n_licenses, f.license, (first - 1)::BIGINT AS first_word,
  last::BIGINT AS last_word, coalesce(ppm, 0)::BIGINT AS dice_ppm
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN f ON d.doc_id = f.doc_id
"""
