"""Operator 1: licence scans by diagonal voting.

Every rolling pair of words of every text is hashed and joined with the positions of the same
pairs in a fixed list of licence templates (whole licence texts and notices, and short phrases; a
broadcast table of constant size). A hit at word `pos` on template position `tpos` votes for the
diagonal `pos - tpos`. Votes are gathered by text, template and diagonal, as bits of the template's
stretches of `BITS` positions; neighbouring diagonals (insertions or deletions of up to `slack` words)
are merged; a span is verified when enough of the template's positions are covered.

Defined results: a null or empty text has no words, no labels and score 0; identical rows each keep
their own output row; null ids are carried as null; an empty table gives an empty result; texts are
taken whole, however long (a row's words stay in one task); further columns of the input are ignored,
whatever their names.
The exploded pairs never leave the map side: votes are combined there, and only they and one marker a
document are shuffled, by a row number, so that neither a source nor a group of copies meets in one
task.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.llm.common import LOWER, UPPER, table

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases: (label, words, counts as a base phrase)
TEMPLATES = [
    ("cc-by", "cc by", True),
    ("gpl", "general public license", True),
    ("reserved", "all rights reserved", True),
    ("agpl", "gnu affero general public license", False),
    ("apache-2.0", "licensed under the apache license version 2 0", False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
    ("cc-by-nc", "creative commons attribution noncommercial", False),
    ("cc-by-sa", "creative commons attribution sharealike", False),
    ("cc-licensed", "licensed under a creative commons attribution", False),
    ("gpl-2.0", "gnu general public license version 2", False),
    ("gpl-3.0", "gnu general public license version 3", False),
    ("lgpl", "gnu lesser general public license", False),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", False),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", False),
    ("public-domain", "released into the public domain", False),
]
#: Whole texts: (label, text), without their copyright lines.
WHOLE = [
    ("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
        WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE."""),
    ("bsd-text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
        BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
        THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("isc-text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
        AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("apache-2.0-notice", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
        or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."""),
    ("mpl-2.0-notice", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
        compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
]
K = 2
BITS = 60  # positions of one stretch of votes
#: Templates of up to so many pairs, base phrases and versions among them, must be covered whole.
EXACT = 6
#: Word pairs that would vote in any prose seed nothing by themselves.
COMMON = {"a", "and", "any", "are", "at", "by", "for", "in", "is", "of", "on", "or", "that", "the", "this", "to", "was", "with"}


def words_of(text: str) -> list[str]:
    """The words of a template, as those of texts."""
    return re.findall(WORD, "".join(c.lower() if c.isascii() else c for c in text))


ALL = [*TEMPLATES, *((label, " ".join(words_of(text)), False) for label, text in WHOLE)]


def template_positions(templates=ALL) -> list[tuple]:
    """(tid, label, base, tpos, stretch, pairs that seed, own bit, a, b) for each seeding word pair."""
    out = []
    for tid, (label, phrase, base) in enumerate(templates):
        words = phrase.split()
        seeds = [i for i in range(len(words) - K + 1) if base or not {words[i], words[i + 1]} <= COMMON]
        assert not base or len(seeds) == len(words) - 1 < BITS
        out += [(tid, label, base, i, i // BITS, len(seeds), 1 << i % BITS, words[i], words[i + 1]) for i in seeds]
    return out


def license_scan(docs: DataFrame, templates=ALL, id_col: str = "doc_id", text_col: str = "text", coverage: float = 0.8, slack: int = 2) -> DataFrame:
    """Spans: one row for each document and verified span, and one marker row a document.

    Columns: at (the row's number), id, n_words, label (null in the marker row), base, start (word), covered (0 to 1).
    """
    spark = docs.sparkSession
    fields = "tid int, label string, base boolean, tpos int, stretch int, n_seeds int, vote long, ta string, tb string"
    seeds = spark.createDataFrame([(-1, None, False, 0, 0, 1, 1, None, None), *template_positions(templates)], fields)
    seeds = seeds.withColumn("th", F.when(F.col("tid") < 0, F.lit(0)).otherwise(F.xxhash64("ta", "tb")))

    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    words = docs.select(F.monotonically_increasing_id().alias("at"), F.col(id_col).alias("id"), F.array_remove(F.split(text, NOT_WORD, -1), "").alias("w"))
    words = words.withColumn("n_words", F.size("w").cast("long"))
    pairs = F.slice(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b")), 1, F.greatest(F.size("w") - 1, F.lit(0)))
    marker = F.array(F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
    grams = words.select("at", "id", "n_words", F.posexplode(F.concat(marker, pairs)).alias("pos", "g"))
    grams = grams.select("at", "id", "n_words", (F.col("pos") - 1).alias("pos"), F.col("g.a").alias("a"), F.col("g.b").alias("b"))
    grams = grams.withColumn("h", F.when(F.col("pos") < 0, F.lit(0)).otherwise(F.xxhash64("a", "b")))
    # the templates are a constant of this module or an argument held in memory: bounded
    hits = grams.join(F.broadcast(seeds), (F.col("h") == F.col("th")) & F.col("a").eqNullSafe(F.col("ta")) & F.col("b").eqNullSafe(F.col("tb")))
    hits = hits.withColumn("diag", F.when(F.col("tid") < 0, 0).otherwise(F.col("pos") - F.col("tpos")))
    of = ["at", "id", "n_words", "tid", "label", "base", "n_seeds"]
    voted = hits.groupBy(*of, "diag", "stretch").agg(F.bit_or("vote").alias("votes"))  # combined before the shuffle
    near = Window.partitionBy("at", "tid").orderBy("diag", "stretch")
    last = F.lag("diag").over(near)
    fresh = F.coalesce(F.when(F.col("base"), F.col("diag") != last).otherwise(F.col("diag") - last > slack), F.lit(True))
    voted = voted.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(near))
    merged = voted.groupBy(*of, "span", "stretch").agg(F.bit_or("votes").alias("votes"), F.min("diag").cast("long").alias("start"))
    spans = merged.groupBy(*of, "span").agg(F.sum(F.bit_count("votes")).alias("held"), F.min("start").alias("start"))
    spans = spans.withColumn("covered", F.col("held") / F.col("n_seeds"))
    return spans.filter((F.col("tid") < 0) | F.when(F.col("n_seeds") <= EXACT, F.col("covered") == 1.0).otherwise(F.col("covered") >= coverage))


def scan_digest(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spans = license_scan(docs, **options)
    base = F.when(F.col("base"), F.col("start"))
    out = spans.groupBy("at", "id", "n_words").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("tid") >= 0, F.col("covered"))), F.lit(0.0)).alias("score"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 6).alias("score"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_digest(table(spark, sf_dir, "documents"))


def _sql() -> str:
    values = ", ".join(f"({t}, '{label}', {str(base).lower()}, {p}, {st}, {n}, {v}, '{a}', '{b}')" for t, label, base, p, st, n, v, a, b in template_positions())
    return f"""
WITH seeds(tid, label, base, tpos, stretch, n_seeds, vote, ta, tb) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w))) AS i, w FROM d),
hits AS (SELECT DISTINCT r, i - 1 - tpos AS diag, tid, label, base, n_seeds, tpos FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b FROM g) x JOIN seeds s ON x.a = s.ta AND x.b = s.tb),
marked AS (SELECT *, CASE WHEN coalesce(diag - lag(diag) OVER (PARTITION BY r, tid ORDER BY diag) > (CASE WHEN base THEN 0 ELSE 2 END), true) THEN 1 ELSE 0 END AS fresh FROM hits),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY r, tid ORDER BY diag) AS span FROM marked),
spans AS (SELECT r, tid, label, base, n_seeds, span, min(diag)::BIGINT AS start, count(DISTINCT tpos) / n_seeds::DOUBLE AS covered FROM numbered GROUP BY r, tid, label, base, n_seeds, span),
good AS (SELECT * FROM spans WHERE CASE WHEN n_seeds <= {EXACT} THEN covered = 1 ELSE covered >= 0.8 END),
by_doc AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(covered) AS score FROM good GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6)::DOUBLE AS score
FROM d LEFT JOIN by_doc USING (r)"""


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLE_SQL = {"op1_license_scan": _sql()}
