"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory, with DataFrame functions only."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, broadcast_if_small, let, load, save

#: Licences as their publishers give them: short ones whole and by their parts, long ones by their titles and the notices that they ask for.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = """2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE_2 = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def _gnu(title: str, version: str) -> list[str]:
    """The notice that a GNU licence asks for, alone and with what follows it."""
    what = "library" if "Lesser" in title and version.startswith("2") else "program"
    notice = f"""This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {title} as published by the Free Software Foundation,
either version {version} of the License, or (at your option) any later version."""
    rest = f"""This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU {title} for more details. You should have received a copy of the GNU {title} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""
    return [notice, notice + " " + rest, f"Licensed under the GNU {title}, version {version}.", f"This work is licensed under the GNU {title}, version {version}."]


_TEXTS = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", _APACHE, _APACHE + " " + _APACHE_2],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "MIT License", "The MIT License (MIT)", _MIT, f"{_MIT} {_MIT_NOTICE} {_WARRANTY}"],
    "ISC": ["ISC License", "Licensed under the ISC License.", _ISC, f"{_ISC} {_ISC_WARRANTY}"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Licensed under the BSD 2-Clause License.", f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_WARRANTY}"],
    "BSD-3-Clause": ["BSD 3-Clause License", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", _BSD_3, f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_3} {_BSD_WARRANTY}"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", *_gnu("General Public License", "2")],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", *_gnu("General Public License", "3")],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", *_gnu("Lesser General Public License", "2.1")],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This library is licensed under the GNU Lesser General Public License, version 3.", *_gnu("Lesser General Public License", "3")],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", *_gnu("Affero General Public License", "3")],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Creative Commons CC0 1.0 Universal", "CC0 1.0 Universal", "To the extent possible under law the author has waived all copyright under CC0 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
#: Tags that name a licence in a header, after SPDX-License-Identifier.
_TAGS = {"GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"], "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], "LGPL-2.1": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"], "LGPL-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"], "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"]}
#: (licence, text); a licence may have several.
TEMPLATES = tuple((name, t) for name, texts in _TEXTS.items() for t in [*texts, *(f"SPDX-License-Identifier: {x}" for x in _TAGS.get(name, [name]))])
THRESHOLD = 0.8
#: Tokens of a line: letters and digits, with inner points and hyphens.
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Documents of one directory, by id, and what the last line of one that states a licence has.
SHARD = 100
STATED = r"(?i)\b(?:licen[cs]ed under|released under|licen[cs]e)\b"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"


#: Adjoining lines that are compared together, at most; paragraphs and comment blocks are compared whole.
LINES = 3
#: Lines that are a comment, and runs of lines without a token, which part paragraphs.
_COMMENT = r"(?:^|\n)([ \t]*(?:#|//|/?\*|--|;|%)[^\n]*(?:\n[ \t]*(?:#|//|/?\*|--|;|%)[^\n]*)+)"
_GAP = r"\n(?:[^A-Za-z0-9\n]*\n)+"


def template_weights(templates=TEMPLATES) -> tuple[list[tuple[str, dict[str, float]]], dict[str, float]]:
    """Unit TF-IDF vectors of the templates with their licences, and the idf of their tokens; a token of no template has the largest idf."""
    bags = [(name, Counter(re.findall(TOKEN, text.lower()))) for name, text in templates]
    df = Counter(t for _, b in bags for t in b)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
    vectors = []
    for name, b in bags:
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in b.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        vectors.append((name, {t: x / norm for t, x in raw.items()}))
    return vectors, idf


class Bounds:
    """Upper bounds that tell, from sums over its tokens, that a unit of text cannot reach the threshold with any template.

    A unit's squared cosine to a unit vector is at most the vector's squared length on the unit's tokens (Cauchy-Schwarz), so at most the sum of its
    distinct tokens' largest squared weights in any template: `a`. And it is at most the share that tokens of templates have in the
    unit's own squared length; for n occurrences (1 + ln n) ** 2 is at most 4 / e * n, so tokens of templates have at most `b`,
    and `u` distinct others have at least u * top ** 2. Weights are looked up by a hash of the token; where tokens meet in a
    slot the largest weight stands, which only raises the bounds.
    """

    SLOTS = 8192

    def __init__(self, templates, threshold: float):
        vectors, idf = template_weights(templates)
        self.need = threshold * threshold - 1e-9
        self.top = (math.log(1 + len(vectors)) + 1) ** 2
        self.heaviest: dict[str, float] = {}
        for _, v in vectors:
            for t, x in v.items():
                self.heaviest[t] = max(self.heaviest.get(t, 0.0), x * x)
        self.square = {t: 4 / math.e * x * x for t, x in idf.items()}

    def _table(self, spark: SparkSession, of: dict[str, float]) -> Column:
        slots = [0.0] * self.SLOTS
        tokens = list(of)
        at = spark.range(1).select(F.transform(F.array(*map(F.lit, tokens)), self._slot)).first()[0]
        for t, k in zip(tokens, at, strict=True):
            slots[k] = max(slots[k], of[t])
        return F.split(F.lit(",".join(map(repr, slots))), ",").cast("array<double>")  # folded to one constant

    def _slot(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.SLOTS)).cast("int")

    def on(self, spark: SparkSession):
        """A function that gives the struct (a, b, u) of a text."""
        heaviest, square = self._table(spark, self.heaviest), self._table(spark, self.square)

        def of(text: Column) -> Column:
            def sums(tokens: Column) -> Column:
                def each(distinct: Column) -> Column:
                    a = F.aggregate(distinct, F.lit(0.0), lambda acc, k: acc + F.get(heaviest, k))
                    b = F.aggregate(tokens, F.lit(0.0), lambda acc, t: acc + F.get(square, self._slot(t)))
                    return F.struct(a.alias("a"), b.alias("b"), F.size(F.filter(distinct, lambda k: F.get(square, k) == 0)).alias("u"))

                return let(F.transform(F.array_distinct(tokens), self._slot), each)

            return let(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1)), sums)

        return of

    def open(self, a: Column, b: Column, u: Column) -> Column:
        """Whether a unit with such sums may reach the threshold; u may be too small."""
        return (a >= self.need) & (b * (1 - self.need) >= self.need * self.top * u)


def _constants(like: DataFrame, rows: list[dict]) -> DataFrame:
    return like.sparkSession.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(x).alias(k) for k, x in r.items())) for r in rows))))


def _unit_scores(units: DataFrame, templates, threshold: float) -> DataFrame:
    """units (key, unit) with unit a string: (key, license, score) of the best template at or above the threshold."""
    vectors, idf = template_weights(templates)
    top = math.log(1 + len(vectors)) + 1
    weights = _constants(units, [{"token": t, "template": k, "w": x} for k, (_, v) in enumerate(vectors) for t, x in v.items()])
    known = _constants(units, [{"token": t, "idf": x} for t, x in idf.items()])
    names = F.array(*(F.lit(n) for n, _ in vectors))
    tokens = units.select("key", F.explode(F.regexp_extract_all(F.lower("unit"), F.lit(f"({TOKEN})"), F.lit(1))).alias("token"))
    tf = tokens.groupBy("key", "token").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(known), "token", "left")  # as many rows as the templates have tokens
    tf = tf.select("key", "token", ((1 + F.log("n")) * F.coalesce("idf", F.lit(top))).alias("x"))
    norm = tf.groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dot = tf.join(F.broadcast(weights), "token").groupBy("key", "template").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scored = dot.join(norm, "key").select("key", F.get(names, F.col("template")).alias("license"), F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= threshold)
    best = F.max(F.struct(F.col("score"), F.col("license"))).alias("b")
    return scored.groupBy("key").agg(best).select("key", "b.license", "b.score")


def ancestors(path: Column) -> Column:
    """Directories above a path, from the nearest to the root ''."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array(F.lit("")))


def units_of(text: Column, whole: Column, bounds: Bounds, measure) -> Column:
    """What is compared with the templates: runs of up to LINES adjoining lines, paragraphs, blocks of comment lines and, of licence files, the whole
    text. Only those are made whose bounds leave a match possible."""

    def runs_of(lines: Column, m: Column, n: int) -> Column:
        def kept(i: Column) -> Column:
            part = [F.get(m, i - 1 + k) for k in range(n)]
            most = reduce(lambda x, y: F.when(x > y, x).otherwise(y), (x["u"] for x in part))
            return bounds.open(reduce(Column.__add__, (x["a"] for x in part)), reduce(Column.__add__, (x["b"] for x in part)), most)

        first = F.when(F.size(lines) >= n, F.sequence(F.lit(1), F.size(lines) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(first, kept), lambda i: F.array_join(F.slice(lines, i, n), " "))

    def runs(lines: Column) -> Column:
        return let(F.transform(lines, measure), lambda m: F.concat(*(runs_of(lines, m, n) for n in range(1, LINES + 1))))

    def possible(x: Column) -> Column:
        return let(measure(x), lambda m: bounds.open(m["a"], m["b"], m["u"]))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[A-Za-z0-9]"))
    blocks = F.concat(F.split(text, _GAP), F.regexp_extract_all(text, F.lit(_COMMENT), F.lit(1)), F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(let(lines, runs), F.filter(blocks, possible)))


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text", key: str = "key", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Licence of each file: (key, path, license, score, origin).

    Of every text, runs of up to three lines, paragraphs and comment blocks, and of licence files (by name) also the whole, are compared with the
    templates by TF-IDF cosine. A file takes the best match of its own (origin 'own'; of equal scores the last name); otherwise that
    of the nearest directory above it for which a licence file has one or, without licence files in a directory, none
    ('inherited', no score); otherwise null ('none'). Licences of several licence files in a directory: the best score. Distinct
    units are scored once, however many files repeat them, and their scores, being few, go to the files by broadcast if their bytes allow it.

    A null text or path counts as empty; very long texts are read whole; rows with equal keys are kept, each with the best licence of the key;
    empty tables give no rows; further columns are ignored, whatever their names.
    """
    f = files.select(F.col(key).alias("key"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = Bounds(templates, threshold)
    is_license = F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE)
    held = f.select("key", "path", is_license.alias("is_license"), F.explode(units_of(F.col("text"), is_license, bounds, bounds.on(files.sparkSession))).alias("unit"))
    held = save(held.withColumn("id", F.struct(F.xxhash64("unit").alias("x"), F.xxhash64(F.lit(1), "unit").alias("y"))))  # 128 bits stand for a unit in shuffles
    scores = save(_unit_scores(held.groupBy(F.col("id").alias("key")).agg(F.min("unit").alias("unit")), templates, threshold).withColumnRenamed("key", "id"))
    own = held.select("key", "path", "is_license", "id").join(broadcast_if_small(scores), "id").groupBy("key", "path").agg(F.max(F.struct("score", "license")).alias("b"), F.max("is_license").alias("is_license"))
    own = save(own.select("key", "path", "is_license", "b.score", "b.license"))
    directory = ancestors(F.col("path"))[0]
    given = save(own.where("is_license").groupBy(directory.alias("dir")).agg(F.max(F.struct("score", "license")).alias("b")).select("dir", F.col("b.license").alias("inherited")))
    # inheritance is found once for each directory, not for each file
    dirs = f.select(ancestors(F.col("path")).alias("up")).distinct().select(F.col("up")[0].alias("home"), F.posexplode("up").alias("far", "dir"))
    nearest = dirs.join(broadcast_if_small(given), "dir").groupBy("home").agg(F.min(F.struct("far", "inherited")).alias("b")).select("home", "b.inherited")
    mine = own.select(F.col("key").alias("_k"), F.col("path").alias("_p"), "license", "score")
    out = f.select("key", "path", directory.alias("home")).join(broadcast_if_small(mine), F.expr("key <=> _k and path = _p"), "left").join(broadcast_if_small(save(nearest)), "home", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return out.select("key", "path", F.coalesce("license", "inherited").alias("license"), "score", origin.alias("origin"))


def document_files(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """documents as files: source / language / ids by the hundred / id. The table has no paths of its own, so a document that ends with a line
    which states a licence stands for the licence file of its directory, as LICENSE.id."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    name = F.when(F.substring_index(F.rtrim(F.coalesce("text", F.lit("")), F.lit(BLANKS)), "\n", -1).rlike(STATED), F.concat(F.lit("LICENSE."), name)).otherwise(F.concat(name, F.lit(".txt")))
    part = F.coalesce(F.floor(F.col("doc_id") / shard).cast("string"), F.lit(""))
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), part, name).alias("path"), "text")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(document_files(load(spark, sf_dir, "documents")), key="doc_id").withColumnRenamed("key", "doc_id")


def sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same for DuckDB over documents, without the pre-selection of text; document_files gives three levels of directories, of which the last
    holds all files."""
    vectors, idf = template_weights(templates)
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    weights = ", ".join(f"({quote(t)}, {k}, {x!r}e0)" for k, (_, v) in enumerate(vectors) for t, x in v.items())
    names = ", ".join(f"({k}, {quote(n)})" for k, (n, _) in enumerate(vectors))
    known = ", ".join(f"({quote(t)}, {x!r}e0)" for t, x in idf.items())
    runs = " UNION ALL ".join(f"SELECT doc_id, path, dir, given, unnest(list_transform(range(1, len(l) - {n - 2}), lambda i: array_to_string(l[i:i + {n - 1}], ' '))) AS unit FROM l WHERE len(l) >= {n}" for n in range(1, LINES + 1))
    return rf"""
WITH f AS (SELECT doc_id, coalesce(text, '') AS t, regexp_matches(string_split(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+$', ''), chr(10))[-1], '{STATED}') AS given,
  concat(coalesce(source, ''), '/', coalesce(lang, ''), '/', doc_id // {SHARD}) AS dir FROM documents),
p AS (SELECT doc_id, t, given, dir, concat(dir, '/', CASE WHEN given THEN 'LICENSE.' ELSE '' END, doc_id, CASE WHEN given THEN '' ELSE '.txt' END) AS path FROM f),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[A-Za-z0-9]')) AS l FROM p),
held AS ({runs} UNION ALL SELECT doc_id, path, dir, given, unnest(string_split_regex(t, '{_GAP}')) FROM p
  UNION ALL SELECT doc_id, path, dir, given, unnest(regexp_extract_all(t, '{_COMMENT}', 1)) FROM p UNION ALL SELECT doc_id, path, dir, given, t FROM p WHERE given),
units AS (SELECT DISTINCT unit FROM held),
tokens AS (SELECT unit, unnest(regexp_extract_all(lower(unit), '{TOKEN}')) AS token FROM units),
weights(token, k, w) AS (VALUES {weights}),
names(k, license) AS (VALUES {names}),
known(token, idf) AS (VALUES {known}),
tf AS (SELECT unit, token, (1 + ln(count(*))) * coalesce(any_value(idf), {math.log(1 + len(vectors)) + 1!r}e0) AS x FROM tokens LEFT JOIN known USING (token) GROUP BY unit, token),
norm AS (SELECT unit, sqrt(sum(x * x)) AS norm FROM tf GROUP BY unit),
scored AS (SELECT unit, license, round(sum(x * w) / any_value(norm), 9) AS score FROM tf JOIN weights USING (token) JOIN norm USING (unit) JOIN names USING (k) GROUP BY unit, k, license),
own AS (SELECT doc_id, path, dir, given, max({{'s': score, 'l': license}}) AS b FROM held JOIN scored USING (unit) WHERE score >= {threshold} GROUP BY doc_id, path, dir, given),
dirs AS (SELECT dir, max(b).l AS inherited FROM own WHERE given GROUP BY dir)
SELECT p.doc_id, p.path, coalesce(o.b.l, inherited) AS license, o.b.s AS score, CASE WHEN o.b IS NOT NULL THEN 'own' WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin
FROM p LEFT JOIN own o ON p.doc_id = o.doc_id AND p.path = o.path LEFT JOIN dirs ON p.dir = dirs.dir
"""
