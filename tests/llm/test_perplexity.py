import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from queuelens.llm import perplexity as p

from .conftest import wide


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    marked = {k + d for k in range(len(words) - 2) if grams[tuple(words[k:k + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked))


def test_base_counts_by_brute_force(edge_docs):
    for text in ["", None, "a b c a b c", "a a a a", "x\nx\n \nx", "a b", "#<>|& é z", "a b c\n" * 3,
                 *[r.text for r in edge_docs.select("text").collect()]]:
        assert p.base_counts(text) == plain_counts(text)


def plain_discounts(counts):
    n = [sum(c == k for c in counts) for k in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k for k in (1, 2, 3)]
    return [min(max(d, 0.01), k - 0.01) for k, d in zip((1, 2, 3), raw)]


def plain_kn(texts, order=p.ORDER):
    """Modified Kneser-Ney by dictionaries over code points."""
    lines = [[p.START] * (order - 1) + [ord(c) for c in t] for t in texts]
    counts = {order: Counter(tuple(x[k - order + 1:k + 1]) for x in lines for k in range(order - 1, len(x)))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cut = {n: plain_discounts(list(c.values())) for n, c in counts.items()}

    def prob(gram):
        n = len(gram)
        if n == 0:
            return 2 ** -p.BASE_BITS
        followers = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not followers:
            return prob(gram[1:])
        total = sum(followers.values())
        spare = sum(min(cut[n][min(c, 3) - 1], c) for c in followers.values()) / total
        c = followers.get(gram, 0)
        return (max(c - cut[n][min(c, 3) - 1], 0) / total if c else 0) + spare * prob(gram[1:])

    return prob


TEXTS = ["the cat sat on the mat.", "the dog sat; a cat!", "on the Mat 12", "", "Кот сидел на коврике, кот спал", "猫坐在垫子上 😀"]


@pytest.fixture(scope="module")
def small_model(spark):
    docs = spark.createDataFrame([(t, "xx") for t in TEXTS], "text string, lang string")
    return p.Model.unpack([tuple(r)[3:] for r in p.fit_models(docs).collect()])


def test_model_equals_plain_kneser_ney(small_model):
    prob = plain_kn(TEXTS)
    texts = [*TEXTS, "zebra on a mat", "кот на 😀 mat"]
    got = small_model.code_length(texts)
    for text, bits in zip(texts, got):
        line = [p.START] * (p.ORDER - 1) + [ord(c) for c in text]
        want = sum(-math.log2(prob(tuple(line[k - p.ORDER + 1:k + 1]))) for k in range(p.ORDER - 1, len(line)))
        assert bits == pytest.approx(want, rel=1e-4)


def test_probabilities_sum_to_one(small_model):
    seen = np.array(sorted({ord(c) for t in TEXTS for c in t}), np.int64)
    for context in ("the", "кот", "zzz"):
        points = np.append(seen, ord("ß"))
        lo = ord(context[1]) << 42 | ord(context[2]) << 21 | points
        share = np.exp2(small_model.log2(np.full(len(points), ord(context[0]), np.int64), lo))
        assert share[:-1].sum() + share[-1] * (2 ** p.BASE_BITS - len(seen)) == pytest.approx(1, abs=1e-4)


def test_blocks_cut_long_texts_without_a_trace():
    whole, cut = ([np.concatenate(x) for x in zip(*p.gram_blocks(TEXTS, size))] for size in (1 << 20, 5))
    assert all((a == b).all() for a, b in zip(whole, cut)) and len(whole[0]) == sum(map(len, TEXTS))


def test_counts_over_tasks_and_merging(spark, edge_docs, monkeypatch):
    monkeypatch.setattr(p, "MOST_HELD", 500)
    counted = {(r.lang, r.hi, r.lo): r.n for r in p.gram_counts(edge_docs.repartition(5)).collect()}
    want = Counter()
    for r in edge_docs.collect():
        for hi, lo, _ in p.gram_blocks([r.text or ""]):
            want.update(((r.lang or ""), h, x) for h, x in zip(hi.tolist(), lo.tolist()))
    assert counted == want


def test_model_in_parts_gives_the_same_figures(edge_docs):
    figures = []
    for part_bytes in (64 << 20, 12_000):
        models = p.fit_models(edge_docs, part_bytes=part_bytes)
        assert (models.filter("parts > 1").count() > 0) == (part_bytes == 12_000)
        rows = p.scored(edge_docs, models, keep=False, part_bytes=part_bytes)
        figures.append(sorted((str(r.row.doc_id), r.n_words, r.bits or -1, r.word_bits or -1) for r in rows.collect()))
    assert len(figures[0]) == edge_docs.count()
    for one, other in zip(*figures):
        assert one[:2] == other[:2] and one[2:] == pytest.approx(other[2:], rel=1e-6)


def test_labelled_junk_goes_and_good_texts_stay(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    judged = p.judged(docs, keep=False).select("row.doc_id", "base_failed", "kept").filter("not base_failed")
    share = {r.quality: r.kept for r in judged.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
             .groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[0] <= 0.2 and share[1] >= 0.95


def test_bands_reject_outliers_only(spark):
    import random

    from .conftest import prose
    rng = random.Random(1)
    rows = [(k, prose(rng, 120), "en") for k in range(300)]
    rows += [(900, " ".join("".join(rng.choices("qxzjkvw", k=7)) for _ in range(120)), "en"), (901, "the " * 300, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = {r.row.doc_id: (r.base_failed, r.kept) for r in p.judged(docs, keep=False).collect()}
    assert kept[900] == (False, False) and kept[901] == (True, False)
    assert sum(kept[k][1] for k in range(300)) >= 298


def test_edge_cases(edge_docs, no_docs):
    extra = wide(edge_docs, "row", "bits", "word_bits", "kept", "class", "length", "bits_half", "base_failed")
    judged = p.judged(extra, keep=False).select("row.*", *p.COUNTS, F.col("kept").alias("verdict"), F.col("base_failed").alias("failed"))
    assert judged.count() == edge_docs.count()
    empty = judged.filter("doc_id in (100, 101, 104)").collect()
    assert len(empty) == 3 and all(r.n_words == 0 and r.failed and not r.verdict for r in empty)
    good = p.keep_good(extra)
    assert good.columns == extra.columns and good.filter("doc_id = 8").count() == 3
    assert p.judged(no_docs).count() == 0 and p.keep_good(no_docs).count() == 0


def test_no_row_is_lost_for_want_of_a_model(spark, edge_docs):
    prose = edge_docs.filter("doc_id = 8").first().text
    schema = "doc_id bigint, text string, lang string"
    for rows in ([(1, None, "xx"), (2, prose, "en"), (3, "", "xx"), (4, "", None)], [(1, None, "xx")], [(1, None, None), (2, "", "")]):
        docs = spark.createDataFrame(rows, schema)
        for keep in (True, False):
            got = {r.row.doc_id: (r.n_words > 0, r.base_failed, r.kept) for r in p.judged(docs, keep=keep).collect()}
            assert got == {k: (bool(t), not t, bool(t)) for k, t, _ in rows}
        assert p.keep_good(docs).count() == sum(bool(t) for _, t, _ in rows)
