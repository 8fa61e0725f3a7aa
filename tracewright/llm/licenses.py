"""Licence scans: normalised text against licence templates by the Dice coefficient of word bigrams, with DataFrame operations only.

Texts are compared by unit: each line, each paragraph of several lines, and the whole text. Dice can reach THRESHOLD only
if the smaller set of bigrams has THRESHOLD / (2 - THRESHOLD) times the larger one's members, so a unit whose
size suits no template is dropped, and the size bound joins each of the others with few templates. Before bigrams
are made, units without any anchor are dropped: words of which every match has one. Templates are the list below or a table that a
user hands in. Up to LIMIT their bigrams are broadcast. More of them meet the units by a join of their rarest bigrams, of which every match shares one,
and the pairs so found are compared in full.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracewright.llm.expressions import let
from tracewright.workspace import materialize

#: Dice coefficient from which a unit counts as the template.
THRESHOLD = 0.8
#: Templates whose bigrams are broadcast at most.
LIMIT = 5_000

# Words that most English texts have.
COMMON = {"a", "an", "and", "be", "by", "for", "in", "is", "of", "or", "that", "the", "this", "to", "with"}

# The notices and short texts of public licences.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-3.0-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "0bsd-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "bsd-2-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "all-rights-reserved-short": "All rights reserved.",
    "all-rights-reserved": "All rights reserved. No part of this work may be reproduced without written permission.",
}


def normalised(text: Column) -> Column:
    """ASCII letters and digits in lower case, everything between them one blank."""
    return F.lower(F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))


def anchors(known: dict[str, str], ratio: float) -> list[str]:
    """Words of which every unit that reaches the threshold has one.

    Such a unit shares ratio or more of the template's bigrams, so it has one of any set of more
    than 1 - ratio of them. Each template gives its longest words until their bigrams are that many, very common ones last.
    """
    found = set()
    for text in known.values():
        words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
        pairs = set(zip(words, words[1:], strict=False))
        left = len(pairs) - len(pairs) * (1 - ratio) - 1e-9
        for w in sorted(set(words), key=lambda w: (w in COMMON, w not in found, -len(w), w)):
            if len(pairs) < left:
                break
            pairs = {p for p in pairs if w not in p}
            found.add(w)
    return sorted(found)


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbouring words."""
    pair = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(F.get(words, i), F.lit(" "), w))
    return F.array_distinct(pair)


def templates(spark: SparkSession, known: dict[str, str]) -> DataFrame:
    """(license, bigram, t_size) of the templates: some hundred rows for each text at most."""
    texts = spark.createDataFrame(sorted(known.items()), "license string, text string")
    return texts.select("license", let(F.split(normalised(F.col("text")), " "), bigrams).alias("b")).select("license", F.explode("b").alias("bigram"), F.size("b").alias("t_size"))


def _units(least: float, most: float, worth=None) -> Column:
    """The units of a text whose number of bigrams is from least to most, as structs of pos, unit, body_key and b; worth(body) drops more before bigrams are made."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit("line").alias("unit"), x.alias("body")))
    paragraphs = F.transform(F.filter(F.split("text", r"\n[ \t\r]*\n"), lambda x: F.contains(F.trim(x), F.lit("\n"))), lambda x: F.struct(F.lit("paragraph").alias("unit"), x.alias("body")))
    whole = F.when(F.contains("text", F.lit("\n")), F.array(F.struct(F.lit("text").alias("unit"), F.col("text").alias("body")))).otherwise(F.array().cast("array<struct<unit:string,body:string>>"))
    made = lambda u, i: F.struct(i.alias("pos"), u["unit"].alias("unit"), F.xxhash64(u["body"]).alias("body_key"), let(F.split(normalised(u["body"]), " "), bigrams).alias("b"))
    # a word has a byte at least and a separator follows it; so shorter bodies have too few bigrams
    long = F.filter(F.concat(lines, paragraphs, whole), lambda u: (F.length(u["body"]) > F.lit(2 * least)) & (worth(u["body"]) if worth else F.lit(True)))
    return F.filter(F.transform(long, made), lambda u: F.size(u["b"]).between(least, most))


def _by_join(docs: DataFrame, threshold: float, known: DataFrame) -> DataFrame:
    """matches for templates of any number. A unit that reaches the threshold shares ratio or more of a template's bigrams, so it has one of any more than 1 - ratio of them; each template is joined by
    so many of its bigrams that fewest templates have. What meets is compared in full, by joins of unit and license; nothing is broadcast by us."""
    ratio = threshold / (2 - threshold)
    t = materialize(known.select("license", let(F.split(normalised(F.col("text")), " "), bigrams).alias("t")).where("size(t) > 0").withColumn("t_size", F.size("t")), "templates")
    smallest, largest = t.agg(F.min("t_size"), F.max("t_size")).first()
    flat = t.select("license", "t_size", F.explode("t").alias("bigram"))
    often = flat.groupBy("bigram").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("license").orderBy("n", "bigram"))
    signs = flat.join(often, "bigram").withColumn("place", place).where(F.col("place") <= F.floor((1 - ratio) * F.col("t_size") + 1e-9) + 1).select("bigram", "license", "t_size")
    # the outer form keeps the optimizer from computing the units again in a filter before the explosion
    units = docs.select("doc_id", F.explode_outer(_units(smallest * ratio, largest / ratio)).alias("u")).where("u is not null").select("doc_id", "u.*", F.size("u.b").alias("u_size"), F.monotonically_increasing_id().alias("uid"))
    units = materialize(units, "units")
    near = F.least("u_size", "t_size") >= ratio * F.greatest("u_size", "t_size")
    met = units.select("uid", "u_size", F.explode("b").alias("bigram")).join(signs, "bigram").where(near).select("uid", "license").distinct()
    both = met.join(units, "uid").join(t, "license")
    dice = both.select("doc_id", "license", "unit", (2 * F.size(F.array_intersect("b", "t")) / (F.col("u_size") + F.col("t_size"))).alias("dice")).where(F.col("dice") >= threshold)
    return dice.groupBy("doc_id", "license").agg(F.max(F.struct("dice", "unit")).alias("best"), F.count("*").alias("n_units")).select("doc_id", "license", "best.unit", "n_units", "best.dice")


def matches(docs: DataFrame, threshold: float = THRESHOLD, known: DataFrame | dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, license, unit, n_units, dice): for each document the templates that it holds; known are the texts by license, or a table (license, text), each license once; unit is the kind of the best unit (line, paragraph or text), n_units how many reach the threshold.

    A text of one line is a unit of that kind only. Null and empty texts, and units of fewer than two words, hold
    none. Rows with one doc_id are scanned each and reported together. Other columns play no part.
    """
    spark = docs.sparkSession
    if isinstance(known, DataFrame):
        few = known.select("license", "text").limit(LIMIT + 1).collect()
        if len(few) > LIMIT:
            return _by_join(docs, threshold, known)
        known = {r["license"]: r["text"] for r in few}
    if not known:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, unit string, n_units bigint, dice double")
    table = templates(spark, known)
    smallest, largest = table.agg(F.min("t_size"), F.max("t_size")).first()
    ratio = threshold / (2 - threshold)
    least, most = smallest * ratio, largest / ratio
    words = anchors(known, ratio)
    anchored = lambda text: let(F.lower(text), lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words]))
    fit = _units(least, most, anchored)
    # the outer form keeps the optimizer from computing the units again in a filter before the explosion
    sized = docs.where(anchored(F.col("text"))).select("doc_id", F.explode_outer(fit).alias("u")).where("u is not null").select("doc_id", "u.*", F.size("u.b").alias("u_size"))
    shared = sized.select("doc_id", "pos", "body_key", "unit", "u_size", F.explode_outer("b").alias("bigram")).join(F.broadcast(table), "bigram").where(F.least("u_size", "t_size") >= ratio * F.greatest("u_size", "t_size"))
    dice = shared.groupBy("doc_id", "pos", "body_key", "unit", "license", "u_size", "t_size").agg(F.count("*").alias("both")).withColumn("dice", 2 * F.col("both") / (F.col("u_size") + F.col("t_size")))
    best = F.max(F.struct("dice", F.col("unit"))).alias("best")
    return dice.where(F.col("dice") >= threshold).groupBy("doc_id", "license").agg(best, F.count("*").alias("n_units")).select("doc_id", "license", "best.unit", "n_units", "best.dice")


def op8_license_dice(spark, sf_dir: str) -> DataFrame:
    """Licences in all documents: doc_id, license, unit, n_units, dice."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_NORMAL = "string_split(trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ')"
_BIGRAMS = "list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))])"
ORACLE_SQL = f"""
WITH t AS (SELECT license, {_BIGRAMS} AS b FROM (SELECT license, {_NORMAL.format("text")} AS words FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(TEMPLATES.items()))}) v(license, text))),
tb AS (SELECT license, len(b) AS t_size, unnest(b) AS bigram FROM t),
u AS (
  SELECT doc_id, 'line' AS unit, unnest(string_split(text, chr(10))) AS body FROM documents
  UNION ALL SELECT doc_id, 'paragraph', body FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) AS body FROM documents) WHERE contains(trim(body, ' '), chr(10))
  UNION ALL SELECT doc_id, 'text', text FROM documents WHERE contains(text, chr(10))
),
n AS (SELECT row_number() OVER () AS id, doc_id, unit, {_NORMAL.format("body")} AS words FROM u),
s AS (SELECT id, doc_id, unit, {_BIGRAMS} AS b FROM n),
ub AS (SELECT id, doc_id, unit, len(b) AS u_size, unnest(b) AS bigram FROM s WHERE len(b) > 0),
d AS (SELECT id, doc_id, unit, license, 2.0::DOUBLE * count(*) / (u_size + t_size) AS dice FROM ub JOIN tb USING (bigram) GROUP BY id, doc_id, unit, license, u_size, t_size)
SELECT doc_id, license, max({{'dice': dice, 'unit': unit}}).unit AS unit, count(*) AS n_units, max(dice) AS dice FROM d WHERE dice >= {THRESHOLD} GROUP BY doc_id, license
"""
