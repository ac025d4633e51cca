import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from queuelens.llm import langid

from .conftest import wide


def plain_bits(train, text, order=langid.ORDER):
    """PPM code length (method C, no exclusion) straight from the context counts."""
    seen = defaultdict(Counter)
    for t in train:
        raw = bytes(order) + t.encode()
        for k in range(order, len(raw)):
            for n in range(order + 1):
                seen[raw[k - n:k]][raw[k]] += 1
    raw, bits = bytes(order) + text.encode(), 0.0
    for k in range(order, len(raw)):
        for n in range(order, -1, -1):
            counts = seen.get(raw[k - n:k])
            if not counts:
                continue
            total, kinds = sum(counts.values()), len(counts)
            if raw[k] in counts:
                bits -= math.log2(counts[raw[k]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


SAMPLES = {"en": ["the cat sat on the mat", "where is the hat"], "de": ["die Katze saß auf der Matte", "wo ist der Hut"],
           "fr": ["le chat était assis sur le tapis"]}


def test_code_lengths_by_brute_force():
    tables = langid.Tables.fit(SAMPLES)
    texts = ["the mat is on the cat", "der Hut", "été", "zzz qqq", "a"]
    totals = tables.totals(texts)
    for row, text in zip(totals, texts):
        for column, lang in enumerate(tables.langs):
            assert row[column] == pytest.approx(plain_bits(SAMPLES[lang], text), rel=1e-9)


def test_predictions_and_edges():
    tables = langid.Tables.fit(SAMPLES)
    found = tables.predict(["the hat", "die Matte", None, "", "123 ...", "x" * 200_000])
    assert [f[0] for f in found] == ["en", "de", "und", "und", "und", found[5][0]] and found[5][0] in tables.langs
    assert all(0 <= f[1] <= 1 for f in found) and found[2][1] == 0
    assert langid.Tables([], [], [], [], []).predict(["a"]) == [("und", 0.0, None)]


def test_held_out_accuracy_and_bounded_sample(spark):
    rng = random.Random(2)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["ke", "li", "mo"]}
    rows = [(k, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(30)), lang)
            for k in range(400) for lang in [rng.choice(["aa", "bb"])]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    tables = langid.fit(docs, F.col("doc_id") % 3 != 1, sample_bytes=4000)
    wrong = langid.identify(docs.filter("doc_id % 3 = 1"), tables).filter("lang_pred <> row.lang").count()
    assert wrong == 0
    with pytest.raises(ValueError):
        langid.fit(docs, F.lit(True), most_langs=1)


def test_documents(edge_docs, no_docs):
    extra = wide(edge_docs, "row", "in_text", "lang_pred", "score")
    tables = langid.fit(extra, F.lit(True))
    found = langid.identify(extra, tables)
    assert found.count() == edge_docs.count()
    assert {r.lang_pred for r in found.filter("row.doc_id in (100, 101, 104)").collect()} == {"und"}
    kept = langid.keep_known(extra, tables)
    assert kept.columns == extra.columns and kept.filter("doc_id = 8").count() == 3
    assert langid.fit(no_docs, F.lit(True)).langs == [] and langid.keep_known(no_docs, tables).count() == 0


def test_unlearned_languages_and_random_letters_go(spark):
    rng = random.Random(5)
    syllables = {"aa": ["ka", "lo", "mi", "sen", "tur"], "bb": ["ke", "li", "mo", "dag", "vor"]}

    def words(parts):
        return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(60))
    rows = [(k, words(syllables[lang]), lang) for k in range(300) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(k, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=400)), None) for k in range(1000, 1040)]
    rows += [(k, words(["qui", "wex", "jaf", "zop"]), None) for k in range(2000, 2040)]
    rows += [(3000, rows[0][1] + " " + rows[1][1], "rare"), (3001, None, None), (3002, "", "aa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    tables = langid.fit(docs, F.lit(True), limits=True)
    assert set(tables.limits) == {"aa", "bb"}
    kept = {r.doc_id for r in langid.keep_known(docs, tables).collect()}
    assert not any(k in kept for k in range(1000, 3000)) and not kept & {3001, 3002} and 3000 in kept
    assert sum(k in kept for k in range(300)) >= 297
    # without limits the score alone lets them pass
    assert langid.keep_known(docs.where("doc_id >= 1000 AND doc_id < 3000"), langid.fit(docs, F.lit(True))).count() > 60


def test_limits_by_brute_force():
    texts = [f"{a} {b} sat on the {c}" for a in ("the", "a") for b in ("cat", "dog", "hen") for c in ("mat", "hat", "bed")]
    from zlib import crc32
    halves = [[t for t in sorted(texts) if crc32(t.encode()) % 2 == k] for k in (0, 1)]
    figures = sorted(plain_bits(halves[1 - k], t) / len(t) for k in (0, 1) for t in halves[k])
    import numpy as np
    middle, high = np.quantile(figures, [0.5, 0.99])
    limits = langid.held_out_limits({"en": texts * 2, "few": ["one text"]})
    assert limits == {"en": pytest.approx(max(2 * high - middle, langid.SLACK * middle))}
    assert langid.held_out_limits({}) == {}


def test_huge_documents_do_not_starve_the_sample(spark, monkeypatch):
    """100 short texts beside one huge text: the sample is filled in hash order all the same."""
    rows = [(k, f"kalomi lomika {k}", "aa") for k in range(100)] + [(500, "mika " * 4_000_000, "aa")]
    rows += [(k, f"zuzu tete {k}", "bb") for k in range(1000, 1005)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    keys = {r.doc_id: r.key for r in docs.select("doc_id", F.xxhash64("doc_id", "text", F.lit("langid")).alias("key")).collect()}
    found = []
    monkeypatch.setattr(langid.Tables, "fit", classmethod(lambda cls, samples: found.append(samples)))
    langid.fit(docs, F.lit(True), sample_bytes=1000)
    want, held = [], 0
    for doc_id, text, _ in sorted(rows[:101], key=lambda r: keys[r[0]]):
        if held < 1000:
            want.append(text[:1000])
            held += len(text[:1000])
    assert found[0]["aa"] == want and len(found[0]["bb"]) == 5


def test_null_and_repeated_ids_fill_the_sample(spark, monkeypatch):
    """Rows are drawn one by one, also where all of them have one id or none."""
    rows = [(7 if k % 2 else None, f"kalomi lomika number {k:06d}", "ab"[k % 2]) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    found = []
    monkeypatch.setattr(langid.Tables, "fit", classmethod(lambda cls, samples: found.append(samples)))
    picked = []
    whole = langid._at_most
    monkeypatch.setattr(langid, "_at_most", lambda cuts: picked.append(cuts) or whole(cuts))
    langid.fit(docs, F.lit(True), sample_bytes=2700)
    assert {lang: sum(map(len, texts)) for lang, texts in found[0].items()} == {"a": 2700, "b": 2700}
    # no more rows than the sample holds pass the filter, but for those of the last cell
    key = F.xxhash64("doc_id", "text", F.lit("langid"))
    assert docs.withColumn("key", key).where(whole(picked[0])).count() <= 202


def test_limits_come_from_all_texts_and_not_from_the_sample(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["cat", "dog", "hen", "mat", "hat", "zebra", "quokka"], k=40)) for _ in range(400)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts + texts[:50])], "doc_id bigint, text string, lang string")
    # a sample of everything gives the limits of the whole, in steps
    whole = langid.fit(docs, F.lit(True), limits=True).limits
    assert whole == {"en": pytest.approx(langid.held_out_limits({"en": texts})["en"], abs=3 / langid.STEPS)}
    # with a small sample all texts still count: here only the tables of the halves are the sample's
    sent = {}
    real = langid.limits_of_all
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(langid, "limits_of_all", lambda rows, tables, most: sent.update(n=rows.count(), t=tables) or real(rows, tables, most))
        limits = langid.fit(docs, F.lit(True), sample_bytes=4000, limits=True).limits
    assert sent["n"] == 450
    bits = [b for b in langid.held_out_bits(sent["t"], [("en", t) for t in texts], 4000) if b is not None]
    assert len(bits) == 400
    import numpy as np
    middle, high = np.quantile(bits, [0.5, 0.99])
    assert limits == {"en": pytest.approx(max(2 * high - middle, langid.SLACK * middle), abs=3 / langid.STEPS)}
