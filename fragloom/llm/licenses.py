"""License scans by diagonal voting, in DataFrame operations alone.

A document's words are runs of digits, letters a to z (A-Z lower-cased first) and all that is not ASCII. All rolling
K-word grams of every document are hashed and joined to the gram positions of the license templates; a hit is verified
by comparing the words themselves. Hits are counted by offset diagonal (document position less template position),
diagonals within SLIP of each other are merged, and a merged span counts when it holds COVER of its template's grams
within STRETCH of the template's length. Besides, the base labels are places where a phrase's words stand consecutively.

Only hits are shuffled. Templates are a parameter, a bounded list that is broadcast; the default ones hold whole
licenses, the notices that stand for long ones, and one-line forms.

Defined cases: null or empty text has no words, empty labels and score 0; a null id is kept; repeated rows come back as
often as they came in (their hits are the same); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragloom.llm.common import ASCII_LOWER, ASCII_UPPER

K, SLIP, COVER, STRETCH = 3, 2, 0.6, 1.5
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The phrases and labels of the base scan, and public license statements.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction,"
    " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to"
    " do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
    " NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF"
    " OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND"
    " FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
    " (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN"
    " CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in"
    " all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL"
    " THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR"
    " OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
    " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR"
    " CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or"
    " (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A"
    " PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."
)
MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
)
TEMPLATES = [
    ("mit", "Released under the MIT License."), ("mit", MIT[: MIT.index(", including without")]), ("mit", MIT),
    ("apache", "Licensed under the Apache License, Version 2.0."), ("apache", APACHE[APACHE.index("you may not") : APACHE.index(" http")]), ("apache", APACHE),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."), ("gpl", GPL[: GPL.index(", either version")]), ("gpl", GPL),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."), ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", BSD[: BSD.index(" 1. Redis")]), ("bsd", BSD), ("isc", ISC[: ISC.index(", provided")]), ("isc", ISC), ("mpl", MPL[: MPL.index(" If a copy")]), ("mpl", MPL),
]


def _words_of(text: str) -> list[str]:
    return [w for w in re.split(BREAK, text.lower()) if w]


def template_grams(spark, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(t, label, tpos, grams, parts, gram): fixed, a row for each template position."""
    rows = [{"t": t, "label": label, "tpos": i, "grams": len(w) - k + 1, "parts": w[i : i + k]} for t, (label, text) in enumerate(templates) for w in [_words_of(text)] for i in range(len(w) - k + 1)]
    made = F.from_json(F.lit(json.dumps(rows)), "array<struct<t:int,label:string,tpos:int,grams:int,parts:array<string>>>")
    return spark.range(1).select(F.explode(made).alias("x")).select("x.*").withColumn("gram", F.xxhash64(*[F.get("parts", F.lit(j)) for j in range(k)]))


def _places(words, phrase: str):
    """Start positions of a phrase."""
    parts = phrase.split()
    here = lambda i: F.forall(F.sequence(F.lit(0), F.lit(len(parts) - 1)), lambda j: F.get(words, i + j) == F.get(F.array(*[F.lit(p) for p in parts]), j))
    last = F.size(words) - len(parts)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def spans(worded: DataFrame, templates=TEMPLATES, k: int = K, cover: float = COVER) -> DataFrame:
    """(id, h, label, start, stop, score): the verified license spans of rows (id, h, words), in word positions (stop excluded)."""
    grams = F.transform(F.sequence(F.lit(0), F.size("words") - k), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(k)]))
    rolled = worded.where(F.size("words") >= k).select("id", "h", "words", F.posexplode(grams).alias("pos", "gram"))
    hits = rolled.join(F.broadcast(template_grams(worded.sparkSession, templates, k)), "gram").where(F.slice("words", F.col("pos") + 1, k) == F.col("parts"))
    votes = hits.groupBy("id", "h", "t", "label", "grams", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("held"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    line = Window.partitionBy("id", "h", "t").orderBy("diagonal")
    parted = votes.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > SLIP).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    merged = parted.groupBy("id", "h", "t", "label", "grams", "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("n"), F.min("low").alias("start"), (F.max("high") + k).alias("stop"))
    good = merged.where((F.col("n") >= cover * F.col("grams")) & (F.col("stop") - F.col("start") <= STRETCH * (F.col("grams") + k - 1) + SLIP))
    return good.select("id", "h", "label", "start", "stop", (F.col("n") / F.col("grams")).alias("score"))


def _worded(docs: DataFrame) -> DataFrame:
    """(id, h, words) for each row of docs; h: a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(F.translate(text, ASCII_UPPER, ASCII_LOWER), BREAK), "")
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("h"), words.alias("words"))


def base_report(docs: DataFrame) -> DataFrame:
    """(id, h, n_words, n_base, first_word, last_word, base): the base scan of each row of docs."""
    based = _worded(docs)
    # every phrase ends in this word, so that texts without it need no scan of their places
    some = F.when(F.array_contains("words", "license"), F.col("words")).otherwise(F.array().cast("array<string>"))
    scanned = based.select("id", "h", F.size("words").cast("long").alias("n_words"), some.alias("words"))
    placed = scanned.select("id", "h", "n_words", *[_places(F.col("words"), p).alias(PHRASES[p]) for p in PHRASES])
    names = sorted(PHRASES.values())
    every = F.concat(*[F.col(n) for n in names])
    base = F.array_compact(F.array(*[F.when(F.size(n) > 0, F.lit(n)) for n in names]))
    return placed.select("id", "h", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), base.alias("base"))


def license_report(docs: DataFrame, templates=TEMPLATES, k: int = K, cover: float = COVER) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, spans, score) for each row of docs."""
    told = spans(_worded(docs), templates, k, cover)
    voted = told.groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set("label").alias("more"), F.max("score").alias("best"), F.sort_array(F.collect_list(F.struct("start", "stop", "label", "score"))).alias("spans"))
    placed = base_report(docs)
    out = placed.join(voted, placed["id"].eqNullSafe(voted["_id"]) & (placed["h"] == voted["_h"]), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0)))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "spans", score.alias("score"))


def license_base(spark, sf_dir: str) -> DataFrame:
    """The base scan alone, which SQL can express."""
    found = base_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"))


BASE_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), places AS (
  SELECT doc_id, len(w) AS n_words,
         list_filter(range(len(w)), lambda i: w[i + 1] = 'mit' AND coalesce(w[i + 2], '') = 'license') AS mit,
         list_filter(range(len(w)), lambda i: w[i + 1] = 'apache' AND coalesce(w[i + 2], '') = 'license') AS apache,
         list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND coalesce(w[i + 2], '') = 'public' AND coalesce(w[i + 3], '') = 'license') AS gpl
  FROM words
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(mit) + len(apache) + len(gpl) AS BIGINT) AS n_base,
       list_min(mit || apache || gpl) AS first_word, list_max(mit || apache || gpl) AS last_word,
       concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels
FROM places
"""


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return license_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
