"""License scan: an exact set-similarity join of text blocks with templates.

Only DataFrame functions are used.  A block is a line of text, or a run of
words across line ends, a quarter longer than the template, so that a passage
is found however it is wrapped.  A block and a template match if the block holds at least ``THRESHOLD`` of the template's
distinct words.  Words are put in one global order, rarest in the corpus first;
a matching block must hold a word of the template's prefix in that order, so
the join is an equi-join on prefix words, followed by the length filter, the
positional filter and exact verification.  The templates are a parameter of
known, small size; all that is broadcast grows with them and not with the data.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, row_key
from .quality_rules import _let

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Percent of a template's distinct words that a block must hold.
THRESHOLD = 80

PHRASES = [(("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")]

#: Sentences by which licenses are announced, and the texts and notices of short licenses.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("cc", "licensed under a creative commons attribution 4 0 international license"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "boost",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
]


def template_words(text: str) -> list[str]:
    """The words of a template, as those of documents."""
    return [w for w in re.split(BREAK, text.lower()) if w]


def any_of(words: list[str]) -> str:
    """A pattern of whole words; letters that begin several stand in it once, so that most places are left after one step."""

    def branch(rest: list[str]) -> str:
        heads = sorted({w[0] for w in rest if w})
        parts = "|".join(re.escape(c) + branch([w[1:] for w in rest if w and w[0] == c]) for c in heads)
        return "" if not heads else f"(?:{parts})?" if "" in rest else parts if len(heads) == 1 else f"(?:{parts})"

    return rf"(?i)(?<![0-9a-z])(?:{branch(words)})(?![0-9a-z])"


def words_of(lowered: Column) -> Column:
    """The words of a text whose A-Z are lower-case already."""
    return F.filter(F.split(lowered, BREAK), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def phrase_places(words: Column) -> Column:
    """Structs (start, label) of all places of the base phrases."""

    def starts(phrase: tuple[str, ...], label: str) -> Column:
        here = lambda i: F.get(words, i) == phrase[0]
        test = lambda i: _all(here(i), *(F.coalesce(F.get(words, i + k) == w, F.lit(False)) for k, w in enumerate(phrase) if k))
        found = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.coalesce(test(i), F.lit(False)))
        return F.transform(found, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

    return F.concat(*(starts(p, label) for p, label in PHRASES))


def _all(first: Column, *rest: Column) -> Column:
    for x in rest:
        first = first & x
    return first


def template_table(spark: SparkSession, docs: DataFrame, text_col: str, templates: list[tuple[str, str]], threshold: int) -> tuple[DataFrame, list[str], list[str]]:
    """(one row for each template and prefix word, all template words in global order, all prefix words)."""
    sets = [(label, sorted(set(template_words(t))), len(template_words(t)) * 5 // 4) for label, t in templates]
    vocabulary = sorted({w for _, s, _ in sets for w in s})
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = F.array(*map(F.lit, vocabulary))
    rows = docs.select(F.explode(F.array_intersect(F.split(F.lower(text), BREAK), known)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    often = {r["w"]: r["n"] for r in rows.collect()}  # no more rows than template words
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    out, prefixes = [], set()
    for label, s, span in sets:
        s = sorted(s, key=rank.get)
        need = ceil(len(s) * threshold / 100)
        for i, w in enumerate(s[: len(s) - need + 1]):
            out.append((w, label, s, need, i, span))
            prefixes.add(w)
    return spark.createDataFrame(out, "prefix_word string, label string, template array<string>, need int, t_place int, span int"), order, sorted(prefixes)


def template_matches(docs: DataFrame, row_key: Column, text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """(row_key, line, label, containment) of every block and template that match; line is null for runs of words.

    Null and empty texts have no blocks.  A block that matches several
    templates of one label gives its greatest containment.
    """
    spark = docs.sparkSession
    table, order, prefixes = template_table(spark, docs, text_col, templates, threshold)
    ordered, prefix = F.array(*map(F.lit, order)), F.array(*map(F.lit, prefixes))
    any_prefix = any_of(prefixes)
    lines = docs.where(F.col(text_col).rlike(any_prefix)).select(row_key.alias("row_key"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "raw"))
    lines = lines.where(F.col("raw").rlike(any_prefix)).select("row_key", "line", F.array_intersect(ordered, F.split(ascii_lower(F.col("raw")), BREAK)).alias("block"))
    probes = lines.select("*", F.posexplode("block").alias("b_place", "prefix_word")).where(F.array_contains(prefix, F.col("prefix_word")))
    left = F.least(F.size("template") - F.col("t_place"), F.size("block") - F.col("b_place"))
    pairs = probes.join(F.broadcast(table), "prefix_word").where((F.size("block") >= F.col("need")) & (left + F.least("t_place", "b_place") >= F.col("need")))
    same = F.size(F.array_intersect("template", "block"))
    by_line = pairs.where(same >= F.col("need")).groupBy("row_key", "line", "label").agg(F.max(same / F.size("template")).alias("containment"))
    several = docs.where(F.col(text_col).rlike(any_prefix) & F.col(text_col).contains("\n")).select(row_key.alias("row_key"), words_of(ascii_lower(F.col(text_col))).alias("words"))
    return by_line.unionByName(run_matches(several, table, prefixes, max(len(template_words(t)) * 5 // 4 for _, t in templates)))


def run_matches(docs: DataFrame, table: DataFrame, prefixes: list[str], widest: int) -> DataFrame:
    """(row_key, line, label, containment) of templates and runs of ``span`` words, from (row_key, words).

    A run that matches holds a prefix word, so only the surroundings of prefix
    words are looked at; runs within a line give no more than their line does.
    """
    prefix = F.array(*map(F.lit, prefixes))

    def around(words: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(prefix, F.get(words, i)))
        first = lambda i: F.greatest(i - (widest - 1), F.lit(0))
        return F.transform(at, lambda i: F.struct(F.get(words, i).alias("prefix_word"), (i - first(i)).alias("at"), F.slice(words, first(i) + 1, i - first(i) + widest).alias("near")))

    probes = docs.where(F.size("words") > 0).select("row_key", F.explode(_let(F.col("words"), around)).alias("p")).select("row_key", "p.*")
    first = F.greatest(F.col("at") - F.col("span") + 1, F.lit(0))
    pairs = probes.join(F.broadcast(table), "prefix_word").withColumn("near", F.slice("near", first + 1, F.col("at") - first + F.col("span")))
    pairs = pairs.where(F.size(F.array_intersect("template", "near")) >= F.col("need"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("near") - F.col("span") + 1, F.lit(1)))
    pairs = pairs.withColumn("same", F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.col("template"), F.slice(F.col("near"), i, F.col("span")))))))
    found = pairs.where(F.col("same") >= F.col("need")).groupBy("row_key", "label").agg(F.max(F.col("same") / F.size("template")).alias("containment"))
    return found.select("row_key", F.lit(None).cast("int").alias("line"), "label", "containment")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labels, places of the base phrases and score of every document.

    The score is 1 where a base phrase stands, else the greatest containment of
    a matching template, else 0.  Null texts count as empty: no words, no
    labels (empty strings), null places.  Rows are told apart by id and text,
    so repeated rows repeat their result and null ids are carried through.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = row_key(F.col(id_col), text)
    matches = template_matches(docs, key, text_col).groupBy("row_key").agg(F.collect_set("label").alias("added"), F.max("containment").alias("containment"))
    places = F.when(text.rlike("(?i)license"), _let(words_of(ascii_lower(text)), phrase_places)).otherwise(F.array().cast("array<struct<start:bigint,label:string>>"))
    base = docs.select(F.col(id_col).alias("doc_id"), key.alias("row_key"), n_words_of(text).alias("n_words"), places.alias("places"))
    base = base.select(
        "doc_id", "row_key", "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        F.array_sort(F.array_distinct("places.label")).alias("base"),
    )
    joined = base.join(matches, "row_key", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("added", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d
), places AS (
  SELECT doc_id, p.i AS start, p.label FROM w, LATERAL (
    SELECT i - 1 AS i, CASE WHEN w[i] = 'mit' AND w[i+1] = 'license' THEN 'mit' WHEN w[i] = 'apache' AND w[i+1] = 'license' THEN 'apache'
      WHEN w[i] = 'general' AND w[i+1] = 'public' AND w[i+2] = 'license' THEN 'gpl' END AS label
    FROM (SELECT unnest(range(1, len(w) + 1)) AS i)) p WHERE p.label IS NOT NULL
), templates AS (
  SELECT label, list_distinct(string_split(words, ' ')) AS s FROM (VALUES %s) v(label, words)
), lines AS (
  SELECT doc_id, list_distinct(regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS b FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
), hits AS (
  SELECT doc_id, label, len(list_intersect(s, b)) / len(s) AS c FROM lines, templates WHERE len(list_intersect(s, b)) * 100 >= %d * len(s)
), found AS (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM hits)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
  CAST((SELECT count(*) FROM places p WHERE p.doc_id = w.doc_id) AS BIGINT) AS n_base,
  (SELECT min(start) FROM places p WHERE p.doc_id = w.doc_id) AS first_word,
  (SELECT max(start) FROM places p WHERE p.doc_id = w.doc_id) AS last_word,
  coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT DISTINCT label FROM places p WHERE p.doc_id = w.doc_id)), '') AS base_labels,
  coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM found f WHERE f.doc_id = w.doc_id), '') AS labels,
  CAST(CASE WHEN EXISTS (SELECT 1 FROM places p WHERE p.doc_id = w.doc_id) THEN 1.0 ELSE coalesce((SELECT max(c) FROM hits h WHERE h.doc_id = w.doc_id), 0.0) END AS DOUBLE) AS score
FROM w
""" % (", ".join(f"('{a}', '{' '.join(template_words(b))}')" for a, b in TEMPLATES), THRESHOLD)
