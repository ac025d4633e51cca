import re

import pytest

from queuelens.llm import licences

from .conftest import wide


@pytest.fixture(scope="module")
def classifier(edge_docs):
    return licences.Classifier.fit(edge_docs)


LEAST = 0.7


def plain_grams(line):
    words = re.findall(r"[^\W_]+(?:[.+-][^\W_]+)*", line.lower())
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


def test_no_passage_without_a_key_word_can_hold_a_template():
    keys = licences.key_words(LEAST)
    for template in sum(licences.TEMPLATES.values(), []):
        whole = plain_grams(template)
        left = {g for g in whole if not any(k in w for w in g.split() for k in keys)}
        assert len(left) < LEAST * len(whole), template


def test_wrapped_notices_and_other_wordings(spark, classifier):
    texts = {
        "This work is released into the public\ndomain.": (["public-domain"], 1),
        "Intro text here.\n\nThis work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International\nLicense.":
            (["cc-by-sa"], 1),
        "Distributed under the GPLv3.": (["gpl"], 1),
        "The tool is released under the terms of\nGPL version 2": (["gpl"], 1),
        "MIT License": (["mit"], 1),
        'The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the '
        'Software.\n \nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.": (["mit"], 1),
        "You can redistribute it and/or modify it under the terms of the GNU Affero\nGeneral Public License as published by the "
        "Free Software Foundation, either\nversion 3 of the License, or any later version.": (["agpl"], 1),
        "Made available under the terms of the Eclipse Public License 2.0 which is available at the site.": (["epl"], 1),
        "Use of this source code is governed by a BSD-style\nlicense.": (["bsd"], 1),
        "The software project was late. The general provided his version of the following events.": ([], 0),
        "Released under the MIT License.\n\nSome prose about cats.\n\nLicensed under CC BY 4.0.": (["cc-by", "mit"], 2),
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r.id: (r.licences, r.notices) for r in licences.by_document(docs, classifier).collect()}
    assert found == dict(enumerate(texts.values()))


def plain_passages(text):
    out = []
    for paragraph in re.split(r"\n(?:[^\S\n]*\n)+", text, flags=re.A):
        line = re.sub(r"\s+", " ", paragraph, flags=re.A).strip(" ")
        out += re.split(r"(?<=[.!?]) (?=[\"'(©]*[^\W\d_])(?=[\"'(©]*[A-ZÀ-ÖØ-Þ])", line)
    return out


def test_query_by_scoring_all_passages(spark, sf_dir, classifier):
    """The whole table against all passages scored, also those without a key word."""
    from itertools import groupby
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, k, line) for r in docs.collect() for k, line in enumerate(plain_passages(r.text or ""))]
    judged = classifier.classify(spark.createDataFrame(rows, "doc_id bigint, k int, line string")).where("family <> 'unknown'")
    want = {}
    for r in sorted(judged.collect(), key=lambda r: (r.doc_id, r.k)):
        want.setdefault(r.doc_id, []).append((r.k, r.family))
    found = {r.id: r for r in licences.by_document(docs, classifier).collect()}
    assert len(found) == docs.count() and want
    for doc_id, row in found.items():
        own = want.get(doc_id, [])
        assert row.licences == sorted({f for _, f in own}), doc_id
        assert row.notices == len(list(groupby(enumerate(own), lambda x: (x[1][0] - x[0], x[1][1])))), doc_id


def test_families_and_unknown(spark, classifier):
    lines = [(x, f) for f, known in licences.TEMPLATES.items() for x in known]
    lines += [(x, licences.UNKNOWN) for x in licences.OTHER_LINES]
    lines += [("The files are released under the MIT license", "mit"), ("copyright", licences.UNKNOWN),
              ("Portions licensed under the Apache License, Version 2.0 (see file).", "apache-2.0"),
              ("(c) 2020 Foo Inc. All rights reserved worldwide.", "reserved"),
              ("A new license for taxi drivers, version 2.0 of the rules", licences.UNKNOWN)]
    found = {r.line: r.family for r in classifier.classify(spark.createDataFrame(lines, "line string, want string")).collect()}
    assert found == dict(lines)


def test_template_comparison_by_brute_force(spark, classifier):
    grams = plain_grams
    line = "Licensed under the Apache License, Version 2.0, and more"
    row = classifier.classify(spark.createDataFrame([(line,)], "line string")).first()
    own = grams(line)
    assert row.similarity == pytest.approx(max(max(len(own & grams(t)) / len(grams(t)), len(own & grams(t)) / len(own))
                                               for t in licences.TEMPLATES["apache-2.0"]))


def test_edge_cases(spark, classifier, edge_docs, no_docs):
    long = "word " * 100_000 + "\nReleased under the MIT License.\nThe license plate fell off.\nReleased under the MIT License."
    docs = edge_docs.unionByName(spark.createDataFrame([(500, long), (500, long), (501, "All rights reserved.")],
                                                       "doc_id bigint, text string"), allowMissingColumns=True)
    extra = wide(docs, "at", "id", "line", "line_no", "family", "grams", "features")
    found = licences.by_document(extra, classifier).collect()
    assert len(found) == docs.count()
    assert [(r.licences, r.notices, r.other_lines) for r in found if r.id == 500] == [(["mit"], 2, 1)] * 2
    assert [(r.licences, r.notices) for r in found if r.id in (100, 101, 104)] == [([], 0)] * 3
    assert [r.licences for r in found if r.id == 501] == [["reserved"]]
    # passages run from sentence to sentence: the long line has no end of its own
    assert {(r.id, r.passage_no) for r in licences.scan(extra, classifier).collect() if r.id == 500} == {
        (500, 0), (500, 1), (500, 2)}
    assert licences.by_document(no_docs, classifier).count() == 0


def test_fit_without_documents(no_docs):
    assert licences.Classifier.fit(no_docs, variants=4).threshold >= 0.5


def test_key_words_are_found_without_a_regex_and_the_sample_is_the_same(spark):
    rows = [(k, f"Satz {k} ohne Wort.  Noch\teiner {k}!\n \nThe license {k}.") for k in range(400)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id int, text string")
    line = licences.F.col("line")
    lines = docs.select(licences.F.explode(licences.passages(licences.F.col("text"))).alias("line"))
    assert "RLIKE" not in lines.where(licences.has_key_word(line, LEAST))._jdf.queryExecution().optimizedPlan().toString()
    plain = lines.where(~line.contains("license")).distinct()
    for most in (3, 500):
        want = plain.orderBy(licences.F.xxhash64("line", licences.F.lit("licence")), "line").limit(most)
        got = licences.training_lines(spark, docs, "text", 1, most, LEAST).where("family = 'unknown'").select("line")
        fixed = set(licences.OTHER_LINES)
        assert {r.line for r in got.collect()} - fixed == {r.line for r in want.collect()}
