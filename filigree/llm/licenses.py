"""License scans: Dice coefficient over word bigrams against license templates.

The units that are compared are the lines, the paragraphs and the whole of each text, so a
license is found on its own, in a file of its own, or as a notice in another text. Two sets
of sizes s and t have a Dice coefficient of at most 2 min(s, t) / (s + t); a template is a
candidate only for units whose size lets that reach the threshold.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.common import words_of

THRESHOLD = 0.8

# Public license texts and notices, without their copyright lines.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
CC_NOTICE = "This work is licensed under a Creative Commons {} International License."
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", ISC),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", GPL_NOTICE),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MPL-2.0", MPL_NOTICE),
    ("CC-BY-4.0", CC_NOTICE.format("Attribution 4.0")),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", CC_NOTICE.format("Attribution-ShareAlike 4.0")),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", CC_NOTICE.format("Attribution-NonCommercial 4.0")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def templates(spark: SparkSession, known: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """template (number), license and text."""
    rows = [(i, name, text) for i, (name, text) in enumerate(known)]
    return spark.createDataFrame(rows, "template int, license string, text string")


def units(text: Column) -> Column:
    """The lines of a text, its paragraphs if it has several, and the whole if it has several lines."""
    lines = F.split(text, "\n")
    paragraphs = F.split(text, r"\n[ \t\r]*\n")
    several = lambda parts: F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.size(lines) > 1, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.concat(lines, several(paragraphs), whole)


def bigrams(words: Column) -> Column:
    """Hashes of the different pairs of neighbouring words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b)))


def license_scan(docs: DataFrame, known: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice (the best of the document's units), n_units and first_unit.

    Words are lower-case runs of letters and digits. A unit of one word has no bigram and
    matches nothing, nor do null and empty texts; `units` numbers lines first, then
    paragraphs, then the whole. Rows that repeat a doc_id count as one document. The
    templates are broadcast; they are a parameter of some hundred texts, not a corpus.
    """
    wanted = known.select("template", "license", F.explode(F.array(words_of(F.col("text")))).alias("words"))
    wanted = wanted.select("template", "license", bigrams(F.col("words")).alias("grams")).withColumn("t", F.size("grams"))
    sized = wanted.select("template", "license", "t", F.explode("grams").alias("gram"))
    # The words are made before the units become rows, so that no filter moved down cuts them again.
    worded = F.transform(units(F.coalesce("text", F.lit(""))), words_of)
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(worded).alias("unit", "words"))
    own = parts.where(F.size("words") > 1).select("doc_id", "unit", bigrams(F.col("words")).alias("grams"))
    own = own.withColumn("s", F.size("grams"))
    bounds = wanted.where("t > 0").agg(F.min("t").alias("least"), F.max("t").alias("most")).first()
    ratio = threshold / (2 - threshold)
    own = own.where((F.col("s") >= (bounds["least"] or 0) * ratio) & (F.col("s") <= (bounds["most"] or 0) / ratio))
    met = own.select("doc_id", "unit", "s", F.explode("grams").alias("gram")).join(F.broadcast(sized), "gram")
    met = met.where((F.col("t") >= F.col("s") * ratio) & (F.col("t") <= F.col("s") / ratio))
    shared = met.groupBy("doc_id", "unit", "template", "license", "s", "t").agg(F.count("*").alias("shared"))
    dice = F.col("shared") * 2 / (F.col("s") + F.col("t"))
    found = shared.where(F.col("shared") * 2 >= F.lit(threshold) * (F.col("s") + F.col("t"))).withColumn("dice", dice)
    return found.groupBy("doc_id", "license").agg(
        F.round(F.max("dice"), 6).alias("dice"),
        F.count_distinct("unit").alias("n_units"),
        F.min("unit").alias("first_unit"),
    )
