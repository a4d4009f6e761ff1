"""Operator 1: licence scans, in Spark functions and Spark ML only.

A notice classifier over lines, runs of two and three lines, longer runs of
lines each of which holds a word pair of some template, and whole paragraphs
(parted by blank lines), so that wrapped notices and licence bodies are found
too, over any number of lines: sparse word uni- and bigram logistic regression
(hashed features, L1 part) over licence families and an ``unknown`` class.  It
is trained on notices that are put together from templates by rule, and on
paragraphs of a bounded sample of documents as ``unknown``.  The probability
from which a family is believed is calibrated on training paragraphs that the
fit did not see: the smallest at which at least ``PRECISION`` of them are
right.  A predicted family is confirmed by comparing the notice with that
family's templates: some template must share ``OVERLAP`` of its word bigrams
with it; for a name, one of the names' own words must be among them.

So what has no name's own word, and of each body none of so many bigrams that
``OVERLAP`` can't be reached without them, is passed over (documents first);
nothing that could be confirmed is lost.

Defined results: one row per notice (its first line's place in the text, its
lines), none for the others, nor for a run of lines that holds a shorter one
with a notice; null and empty texts have no paragraphs; rows that repeat a doc_id are
scanned one by one; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectorlint.session import materialize

#: Documents whose paragraphs teach the unknown class, about, and paragraphs taken.
SAMPLE_DOCUMENTS = 400
SAMPLE_PARAGRAPHS = 4_000
FEATURES = 1 << 13
PRECISION = 0.99
OVERLAP = 0.6
UNKNOWN = "unknown"

# Licence families, each with the names it goes by in notices.
FAMILIES = {
    "apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0", "Apache 2.0"],
    "mit": ["the MIT License", "the MIT licence", "MIT"],
    "gpl-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "the GNU GPLv3", "GPL-3.0", "GPL 3.0", "GPLv3", "GPLv3+"],
    "gpl-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL v2", "the GNU GPLv2", "GPL-2.0", "GPL 2.0", "GPLv2", "GPLv2+"],
    "lgpl": ["the GNU Lesser General Public License", "the GNU Lesser General Public License v3.0", "the GNU LGPL v2.1", "LGPL-2.1", "LGPL-3.0", "LGPLv2", "LGPLv2.1", "LGPLv3"],
    "agpl-3.0": ["the GNU Affero General Public License", "the GNU Affero General Public License v3.0", "the GNU AGPL v3", "AGPL-3.0", "AGPLv3"],
    "bsd": ["the BSD 3-Clause License", "the BSD 2-Clause License", "a BSD-style license", "BSD-3-Clause", "BSD-2-Clause"],
    "mpl-2.0": ["the Mozilla Public License, v. 2.0", "the Mozilla Public License 2.0", "MPL-2.0", "MPLv2", "MPLv2.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"],
    "cc-by": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "cc0": ["CC0 1.0", "the Creative Commons CC0 1.0 Universal dedication", "CC0-1.0"],
}
_GNU = "{0} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
# Paragraphs of the licences' texts and standard notices.
BODIES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "gpl-3.0": [_GNU.format("This program is free software:", "General Public License", "3")],
    "gpl-2.0": [_GNU.format("This program is free software;", "General Public License", "2")],
    "lgpl": [_GNU.format("This library is free software;", "Lesser General Public License", "2.1"), _GNU.format("This library is free software:", "Lesser General Public License", "3")],
    "agpl-3.0": [_GNU.format("This program is free software:", "Affero General Public License", "3")],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "cc-by-nc": ["You may not use the material for commercial purposes. You must give appropriate credit, provide a link to the license, and indicate if changes were made."],
    "cc-by-sa": ["If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."],
    "cc-by": ["You must give appropriate credit, provide a link to the license, and indicate if changes were made. You may do so in any reasonable manner, but not in any way that suggests the licensor endorses you or your use."],
    "cc0": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."],
}
# What may stand before a body.
_BEFORE = ["", "Copyright (c) 2024 The Authors. ", "Copyright 2019 by the contributors. All rights reserved. ", "The license of this file: ", "LICENSE ", "/* ", "1. ", "Notice. "]
# How notices introduce a licence.
OPENINGS = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This file is distributed under the terms of {}.",
            "SPDX-License-Identifier: {}", "This program is free software under {}.", "Available under {}.", "The code is covered by {}.",
            "Copyright 2024 The Authors. Licensed under {}.", "You may use this work under {}."]
#: Words of a family's names that no other English sentence needs for its grammar.
_COMMON = set("the a of terms under v version license licence public general style international 1 2 3 4 0 2.0 3.0 4.0 2.1 1.0 by attribution".split())

_WORDS = r"[^a-z0-9]+"


def _words(text: str) -> list[str]:
    return [w for w in re.split(_WORDS, text.lower()) if w]


def _bigrams(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def templates() -> list[tuple[str, str]]:
    """(family, notice) of every name and opening, and of every body."""
    named = [(f, o.format(n)) for f, names in FAMILIES.items() for n in names for o in OPENINGS]
    return named + [(f, x + b) for f, bodies in BODIES.items() for b in bodies for x in _BEFORE]


def _compared(text: str) -> list[str]:
    """A template's distinct bigrams, without its article (single words where it is one)."""
    words = _words(re.sub("^(?:the|a) ", "", text))
    return sorted(set(_bigrams(words) or words))


def body_marks() -> list[str]:
    """Bigrams of the bodies, the longest ones, so many of each that a text
    without any of them can't reach ``OVERLAP``."""
    found = set()
    for body in (b for bodies in BODIES.values() for b in bodies):
        pairs = sorted(_compared(body), key=lambda x: (-len(x), x))
        found.update(pairs[:len(pairs) - math.ceil(OVERLAP * len(pairs)) + 1])
    return sorted(found)


def own_words() -> list[str]:
    """Words that a confirmed paragraph must have one of."""
    found = {w for names in FAMILIES.values() for n in names for w in _words(n)}
    return sorted(w for w in found - _COMMON if not w.isdigit() and len(w) > 1)


def _literal(values: list[str]) -> str:
    return "array(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")"


def _with_words(text: str, use: str) -> str:
    """SQL ``use`` over the words ``w`` of a text, which are split only once."""
    return f"transform(array(filter(split(lower(`{text}`), '{_WORDS}'), x -> x <> '')), w -> {use})[0]"


_PAIRS = "CASE WHEN size(w) > 1 THEN transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1])) ELSE cast(array() AS array<string>) END"


def with_ngrams(df: DataFrame, text: str = "paragraph") -> DataFrame:
    """Adds ``ngrams`` (distinct words and word pairs)."""
    return df.withColumn("ngrams", F.expr(_with_words(text, f"array_distinct(concat(w, {_PAIRS}))")))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph_index, paragraph) of the non-empty lines."""
    lines = docs.select("doc_id", "text").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph_index", "paragraph"))
    return lines.where(F.trim("paragraph") != "")


def notices(docs: DataFrame, holding: str) -> DataFrame:
    """(row, doc_id, paragraph_index, lines, paragraph) of what matches the
    pattern: lines, runs of two and three lines, longer runs of lines that each
    hold a template's word pair, and whole paragraphs.  Every line is a row of its
    own, so that the cost grows with the text."""
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").where(F.col("text").rlike(holding))
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "licence-texts")
    line = texts.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("solid", F.trim("line") != "")
    known = {b for of in (FAMILIES, BODIES) for ts in of.values() for t in ts for b in _compared(t)}
    known |= {w for b in known for w in b.split(" ")}
    line = line.withColumn("told", F.expr(_with_words("line", f"arrays_overlap(if(size(w) > 1, {_PAIRS}, w), {_literal(sorted(known))})")))
    order = Window.partitionBy("row").orderBy("i")
    line = line.select("row", "doc_id", "i", "line", "solid", "told", *[F.lead(c, k).over(order).alias(f"{c}{k}") for c in ("line", "solid") for k in (1, 2)],
                       F.sum((~F.col("solid")).cast("int")).over(order).alias("block"), F.sum((~F.col("told")).cast("int")).over(order).alias("stretch"))
    runs = F.expr("""filter(array(named_struct('n', 1, 'paragraph', line), named_struct('n', if(solid1, 2, 0), 'paragraph', concat_ws('\n', line, line1)),
                                  named_struct('n', if(solid1 AND solid2, 3, 0), 'paragraph', concat_ws('\n', line, line1, line2))), r -> r.n > 0)""")
    short = line.where("solid").select("row", "doc_id", "i", F.explode(runs).alias("r")).select("row", "doc_id", F.col("i").alias("paragraph_index"), F.col("r.n").alias("lines"), "r.paragraph")

    def long(which: str, of: str) -> DataFrame:            # at most the lines of one text
        whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
        g = line.where(which).groupBy("row", of).agg(F.first("doc_id").alias("doc_id"), F.min("i").alias("paragraph_index"), F.count("*").cast("int").alias("lines"), whole.alias("paragraph"))
        return g.where("lines > 3").select(short.columns)

    found = short.unionByName(long("solid", "block")).unionByName(long("told", "stretch"))
    return found.where(F.col("paragraph").rlike(holding)).dropDuplicates(["row", "paragraph_index", "lines"])


def _holding(but: set[str] = frozenset()) -> str:
    marks: dict[str, list[str]] = {}
    for pair in body_marks():
        first, second = pair.split(" ")
        marks.setdefault(first, []).append(second)
    parts = [*(w for w in own_words() if w not in but), *(f"{a}[^a-z0-9]+(?:{'|'.join(b)})" for a, b in sorted(marks.items()))]
    # By first letter, so that most words fail after one comparison.
    first: dict[str, list[str]] = {}
    for x in parts:
        first.setdefault(x[0], []).append(x[1:])
    return r"(?i)(?<![a-z0-9])(?:" + "|".join(f"{a}(?:{'|'.join(b)})" for a, b in sorted(first.items())) + r")(?![a-z0-9])"


def _features(df: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="ngrams", outputCol="features").transform(with_ngrams(df))


def _template_table(spark, names: list[str]) -> DataFrame:
    """(class, template, body, n, ngram): the bigrams of each family's names and bodies, and their number."""
    rows = []
    for k, (body, family, text) in enumerate((b, f, t) for b, of in ((False, FAMILIES), (True, BODIES)) for f, ts in of.items() for t in ts):
        grams = _compared(text)
        rows += [f"({names.index(family)}, {k}, {str(body).lower()}, {len(grams)}, '{g}')" for g in grams]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(class, template, body, n, ngram)")


def train(docs: DataFrame):
    """(model, class names, believed-from probability)."""
    spark = docs.sparkSession
    names = [*sorted(FAMILIES), UNKNOWN]
    rows = ", ".join(f"({names.index(f)}.0D, '{t}')" for f, t in templates())
    notices = spark.sql(f"SELECT * FROM VALUES {rows} AS t(label, paragraph)")
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(n, 1))) < SAMPLE_DOCUMENTS) if n > SAMPLE_DOCUMENTS else docs
    other = paragraphs(some).where(~F.col("paragraph").rlike(r"(?i)licen[sc]e|copyright|SPDX"))
    # Nor do lines with a name's own word or a body's mark, but for names that are common words by themselves ("mit").
    lone = {w for names in FAMILIES.values() for n in names for w in _compared(n) if " " not in w and w.isalpha()}
    other = other.where(~F.col("paragraph").rlike(_holding(lone)))
    other = other.select(F.lit(float(len(names) - 1)).alias("label"), "paragraph").orderBy(F.xxhash64("paragraph"), "paragraph").limit(SAMPLE_PARAGRAPHS)
    plain = spark.sql(f"SELECT {len(names) - 1}.0D AS label, explode({_literal(['A driver needs a license.', 'The general public asked for the terms.', 'Version 2 of the plan was released under pressure.', 'No rights are granted here.', 'all rights reserved'])}) AS paragraph")
    # A notice's copies differ in their opening; every fourth row calibrates. A few thousand rows at most: one
    # partition, so that a step of the fit is one small task.
    data = _features(notices.unionByName(other).unionByName(plain)).withColumn("part", F.pmod(F.xxhash64("paragraph"), F.lit(4))).coalesce(1).cache()
    fit = LogisticRegression(regParam=0.002, elasticNetParam=0.2, maxIter=40, family="multinomial").fit(data.where("part <> 0"))
    probability = F.array_max(vector_to_array("probability"))
    kept = fit.transform(data.where("part = 0")).where(F.col("prediction") < len(names) - 1).select(probability.alias("p"), (F.col("prediction") == F.col("label")).cast("int").alias("right"))
    believed = 0.5
    ranked = sorted(((r.p, r.right) for r in kept.collect()), reverse=True)      # at most a quarter of the training rows
    data.unpersist()
    good = 0
    best = None
    for k, (p, right) in enumerate(ranked, 1):
        good += right
        if good >= PRECISION * k:
            best = p
    return fit, names, max(believed, best) if best is not None else believed


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph_index, paragraph, family, probability, similarity of every licence paragraph."""
    model, names, believed = train(docs)
    held = _features(notices(docs, _holding()))
    scored = model.transform(held).withColumn("p", vector_to_array("probability"))
    scored = scored.select("row", "doc_id", "paragraph_index", "lines", "paragraph", "ngrams", F.col("prediction").cast("int").alias("class"), F.array_max("p").alias("probability"))
    scored = scored.where((F.col("class") < len(names) - 1) & (F.col("probability") >= believed))
    key = ["row", "paragraph_index", "lines"]
    scored = materialize(scored, "licence-scored")
    # The share of each template of the family that the notice holds; the table has some hundred rows.
    shared = (scored.select(*key, "class", F.explode("ngrams").alias("ngram")).join(F.broadcast(_template_table(docs.sparkSession, names)), ["class", "ngram"])
              .groupBy(*key, "template", "body", "n").agg((F.count("*") / F.col("n")).alias("share")).groupBy(*key)
              .agg(F.max(F.when(F.col("body"), F.col("share"))).alias("as_body"), F.max(F.when(~F.col("body"), F.col("share"))).alias("as_name")))
    named = F.arrays_overlap("ngrams", F.expr(_literal(own_words())))
    scored = scored.join(shared, key).withColumn("similarity", F.greatest(F.coalesce("as_body", F.lit(0.0)), F.when(named, F.coalesce("as_name", F.lit(0.0))).otherwise(0.0)))
    scored = scored.where(F.col("similarity") >= OVERLAP)
    scored = scored.select("row", "doc_id", F.struct("paragraph_index", "lines", "paragraph", F.expr(f"get({_literal(names)}, class)").alias("family"), "probability", "similarity").alias("x"))
    # Of runs of lines that lie in one another, the shortest.
    each = scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list("x").alias("all"))
    inside = "y.lines < x.lines AND y.paragraph_index >= x.paragraph_index AND y.paragraph_index + y.lines <= x.paragraph_index + x.lines"
    return (each.select("doc_id", F.explode(F.expr(f"filter(all, x -> NOT exists(all, y -> {inside}))")).alias("x"))
            .select("doc_id", "x.paragraph_index", "x.paragraph", "x.family", "x.probability", "x.similarity"))
