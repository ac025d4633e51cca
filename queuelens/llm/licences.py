"""Licence scans: a trained paragraph classifier, confirmed by template comparison.

A paragraph is a run of lines between blank lines; its line breaks count as spaces, so wrapped notices are whole. It is
judged sentence by sentence (a passage ends at ``.``, ``!`` or ``?`` before a capital), so that a notice within prose
is told from it; each passage gets one family, the likeliest. Passages are turned into lower-case words and then into
single words and word pairs.

Model
    Multinomial logistic regression with an L1 share over those n-grams, so that most weights are zero. Classes are
    the families of ``TEMPLATES`` and ``unknown``. It is trained on the templates, each with ``variants`` versions in
    which a hash drops words, on ``OTHER_LINES`` (sentences with words of licences that are no notices), and on
    ``other_lines`` distinct passages of the corpus without a key word (see below), taken in the order of a hash: a
    bounded sample (default 2,000). Every fourth version is held out, and the probability below which a passage counts
    as unknown is calibrated on what is held out: half way between the most that an unknown passage gets and the least
    that a notice gets, within [0.5, 0.95].

Confirmation
    A predicted family stands if the passage holds ``least`` of the n-grams of one of its templates, or if the template
    holds that share of the n-grams of a passage with a key word. Otherwise the passage is unknown.

Key words
    No list of words: ``key_words`` takes from each template so many words that a passage without any of them lacks
    more than ``1 - least`` of the template's n-grams. A passage without a key word can therefore not be confirmed,
    whatever its score, and is not scored; this drops nothing, and a test compares with scoring all passages.

Edge cases: null and empty texts have no passages and get an empty list; repeated rows are judged each on its own;
an empty table gives an empty result; texts and passages of any length are read whole.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

UNKNOWN = "unknown"

#: Notices of public licences, by family.
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "Licensed under the GNU AGPL, version 3.",
        "Distributed under the AGPLv3.",
        "GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache-2.0": [
        "Apache License 2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License.",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "BSD-style license",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Eclipse Public License v2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "gpl": [
        "Distributed under the GPLv3.",
        "Distributed under the GPLv2.",
        "Released under the terms of GPL version 2.",
        "Released under the terms of the GNU GPL.",
        "GNU General Public License",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "ISC License",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "mit": [
        "MIT License",
        "The MIT License (MIT)",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
        'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the '
        "warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction.',
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "This work is released into the public domain.",
        "Released under CC0 1.0 Universal public domain dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "reserved": [
        "All rights reserved.",
        "Copyright. All rights reserved.",
    ],
}

#: Sentences with words of licences that are no notices.
OTHER_LINES = [
    "The driver lost his license after the accident and had to take the bus.",
    "She applied for a fishing license at the town hall last week.",
    "The debate about copyright law went on for many years in parliament.",
    "His warranty had expired before the machine broke down.",
    "The court issued a warrant for the arrest of the suspect.",
    "The government plans to redistribute income through a new tax.",
    "A gnu is a large antelope that lives in Africa.",
    "The restaurant has a license to serve wine and beer until midnight.",
    "Many old songs are in the public domain because their authors died long ago.",
    "The rights reserved for the owners of the house were discussed at the meeting.",
    "A license plate was found near the bridge.",
    "They asked for permission and it was hereby granted by the king.",
]


def key_words(least: float) -> list[str]:
    """Parts of words, one of which stands in every passage that holds ``least`` of the n-grams of a template."""
    chosen: list[str] = []
    for line in (x for lines in TEMPLATES.values() for x in lines):
        words = re.findall(r"[^\W_]+(?:[.+-][^\W_]+)*", line.lower())
        whole = {(w,) for w in words} | set(zip(words, words[1:]))
        covered = lambda w: any(c in w for c in chosen)
        left = set(whole)
        for word in sorted(set(words), key=lambda w: (not covered(w), -len(w), w)):
            if len(left) < least * len(whole):
                break
            left = {g for g in left if word not in g}
            if not covered(word):
                chosen.append(word)
    return sorted(w for w in chosen if not any(c != w and c in w for c in chosen))


def has_key_word(text: Column, least: float) -> Column:
    """A search for each word in the bytes; a regex would try all words at every character. The text is lowered once."""
    return F.exists(F.array(F.lower(text)), lambda low: reduce(or_, map(low.contains, key_words(least))))


def passages(text: Column) -> Column:
    """The sentences of the paragraphs, white space as one space."""
    # a blank that stands alone is left as it is, and a cut is looked for at blanks only
    cut = lambda p: F.split(F.trim(F.regexp_replace(p, r"\s{2,}|[^\S ]", " ")), r" (?<=[.!?] )(?=[\"'(©]*\p{Lu})")
    return F.flatten(F.transform(F.split(text, r"\n(?:[^\S\n]*\n)+"), cut))


def grams(line: Column) -> Column:
    """Distinct words and word pairs of a line, lower case."""
    found = F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"), F.lit(0))

    def both(words: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1),
                            lambda n: F.concat_ws(" ", F.element_at(words, n), F.element_at(words, n + 1)))
        return F.array_distinct(F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(
            F.array().cast("array<string>"))))

    # the words are bound to a name, so that they are found once and not for every pair
    return F.element_at(F.transform(F.array(found), both), 1)


def _varied(line: Column, version: Column) -> Column:
    """A line without the words that a hash of word, place and version drops (version 0: all stay)."""
    words = F.split(line, " ")
    kept = F.filter(words, lambda w, k: (version == 0) | (F.pmod(F.xxhash64(w, k, version), F.lit(8)) > 0))
    return F.array_join(kept, " ")


def training_lines(spark: SparkSession, docs: DataFrame, text_col: str, variants: int, other_lines: int,
                   least: float) -> DataFrame:
    """(line, family, held): bounded labelled lines."""
    known = [(line, family) for family, lines in TEMPLATES.items() for line in lines]
    fixed = spark.createDataFrame(known + [(line, UNKNOWN) for line in OTHER_LINES], "line string, family string")
    version = F.col("version")
    varied = fixed.withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(variants - 1)))).select(
        _varied(F.col("line"), version).alias("line"), "family", (version % 4 == 3).alias("held"))
    lines = docs.select(F.explode(passages(F.col(f"`{text_col}`"))).alias("line")).where(F.length("line") > 0)
    key = F.xxhash64("line", F.lit("licence"))
    # the first lines in the order of the hash: those of the lowest 64th of the hashes, if they are enough, else of all
    for cut in (-(1 << 63) + (1 << 58), None):
        low = lines if cut is None else lines.where(key < cut)
        plain = low.distinct().where(~has_key_word(F.col("line"), least))
        sample = materialize(plain.orderBy(key, "line").limit(other_lines), "licence-sample")
        if cut is None or sample.count() >= other_lines:
            break
    plain = sample.select("line", F.lit(UNKNOWN).alias("family"), (F.pmod(key, F.lit(4)) == 3).alias("held"))
    return varied.union(plain).where(F.col("line") != "")


class Classifier:
    def __init__(self, vectors: CountVectorizerModel, model: LogisticRegressionModel, families: list[str],
                 threshold: float, least: float):
        self.vectors, self.model, self.families = vectors, model, families
        self.threshold, self.least = threshold, least

    @classmethod
    def fit(cls, docs: DataFrame, text_col: str = "text", variants: int = 24, other_lines: int = 2000,
            least: float = 0.7) -> Classifier:
        spark = docs.sparkSession
        lines = materialize(training_lines(spark, docs, text_col, variants, other_lines, least)
                            .withColumn("grams", grams(F.col("line"))), "licence-training")
        families = [UNKNOWN, *TEMPLATES]
        number = F.create_map(*[F.lit(x) for k, f in enumerate(families) for x in (f, float(k))])[F.col("family")]
        # the n-grams of the fixed lines; what occurs in sampled lines only can tell no family from another
        words = spark.createDataFrame([(x,) for v in [*TEMPLATES.values(), OTHER_LINES] for x in v], "line string")
        vocabulary = sorted(r[0] for r in words.select(F.explode(grams(F.col("line")))).distinct().collect())
        vectors = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features", binary=True)
        data = vectors.transform(lines.withColumn("label", number))
        model = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.3, maxIter=60).fit(
            data.where(~F.col("held")).coalesce(1))  # a bounded sample
        made = cls(vectors, model, families, 0.5, least)
        edge = made.predicted(lines.where("held")).agg(
            F.coalesce(F.max(F.when(F.col("family") == UNKNOWN, F.col("sure"))), F.lit(0.0)),
            F.coalesce(F.min(F.when(F.col("family") == F.col("guess"), F.col("sure"))), F.lit(1.0))).first()
        made.threshold = min(0.95, max(0.5, (edge[0] + edge[1]) / 2))
        return made

    def predicted(self, lines: DataFrame) -> DataFrame:
        """``lines`` (with ``grams``) with the likeliest family ``guess`` other than unknown and its probability ``sure``."""
        scored = self.model.transform(self.vectors.transform(lines)).withColumn("p", vector_to_array("probability"))
        ranked = F.array_max(F.transform(F.sequence(F.lit(1), F.lit(len(self.families) - 1)), lambda k: F.struct(
            F.element_at("p", k + 1).alias("sure"), F.element_at(F.array(*map(F.lit, self.families)), k + 1).alias("guess"))))
        return (scored.withColumn("best", ranked).withColumns({"guess": F.col("best.guess"), "sure": F.col("best.sure")})
                .drop("features", "rawPrediction", "probability", "prediction", "p", "best"))

    def templates(self, spark: SparkSession) -> DataFrame:
        """(guess, templates): the n-grams of each family's templates, one row per family."""
        rows = spark.createDataFrame([(f, x) for f, lines in TEMPLATES.items() for x in lines], "guess string, line string")
        return rows.groupBy("guess").agg(F.collect_list(grams(F.col("line"))).alias("templates"))

    def classify(self, lines: DataFrame) -> DataFrame:
        """``lines`` (column ``line``) with family, probability, similarity; family is ``unknown`` unless confirmed."""
        guessed = self.predicted(lines.withColumn("grams", grams(F.col("line"))))
        compared = guessed.join(F.broadcast(self.templates(lines.sparkSession)), "guess", "left")  # a row per family
        shared = lambda t: F.size(F.array_intersect("grams", t))
        near = F.array_max(F.transform("templates", lambda t: F.greatest(
            shared(t) / F.size(t), F.when((F.size("grams") > 2) & has_key_word(F.col("line"), self.least),
                                          shared(t) / F.size("grams")).otherwise(0.0))))
        sure = (F.col("sure") >= self.threshold) & (F.col("similarity") >= self.least)
        return (compared.withColumn("similarity", near).withColumn("family", F.when(sure, F.col("guess")).otherwise(UNKNOWN))
                .withColumnRenamed("sure", "probability").drop("grams", "templates", "guess"))


def keyed_passages(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(at, id, passage_no, line): the passages with a key word; a row without any has one line, null. ``at`` numbers
    rows."""
    text = F.col(f"`{text_col}`")
    numbered = F.transform(passages(text), lambda line, k: F.struct(k.alias("passage_no"), line.alias("line")))
    gated = F.when(has_key_word(text, least), F.filter(numbered, lambda x: has_key_word(x.line, least)))
    # rows are numbered below the explosion, so that all passages of a row have its number
    rows = docs.select(F.monotonically_increasing_id().alias("at"), F.col(f"`{id_col}`").alias("id"), gated.alias("lines"))
    return rows.select("at", "id", F.explode_outer("lines").alias("x")).select("at", "id", "x.passage_no", "x.line")


def scan(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, passage_no, line, family, probability, similarity) per passage of ``docs`` with a key word."""
    lines = keyed_passages(docs, classifier.least, id_col, text_col).where("line IS NOT NULL")
    return classifier.classify(lines).drop("at")


def by_document(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licences, notices, other_lines): per row of ``docs`` its families in order, how many notices it holds
    (neighbouring passages of one family are one notice), and how many passages with a key word are no notices."""
    lines = keyed_passages(docs, classifier.least, id_col, text_col)
    judged = classifier.classify(lines.withColumn("line", F.coalesce("line", F.lit(""))))
    real = F.col("passage_no").isNotNull()
    notice = real & (F.col("family") != UNKNOWN)
    found = judged.groupBy("at", "id").agg(
        F.array_sort(F.collect_list(F.when(notice, F.struct("passage_no", "family")))).alias("found"),
        F.count(F.when(real & ~notice, 1)).alias("other_lines"))
    begins = lambda x, k: (k == 0) | (F.get("found", k - 1) != F.struct(
        (x.passage_no - 1).alias("passage_no"), x.family.alias("family")))
    return found.select("id", F.array_sort(F.array_distinct("found.family")).alias("licences"),
                        F.size(F.filter("found", begins)).cast("long").alias("notices"), "other_lines")
