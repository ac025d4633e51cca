import random

import corpus_pipeline
from queuelens.llm import nearcopies

from .conftest import wide
from .test_simhash import plain_classes


def plain_set(text, shingle=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[k:k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randint(0, 10**9)}"
    return words


def test_edited_copies_go_and_others_stay(spark, sf_dir):
    """A base of 200 words and copies with 1 to 8 changed words, on both sides of 0.8; brute force is the judge."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=200)
        texts += [" ".join(base), *(" ".join(edited(rng, base, rng.randint(1, 8))) for _ in range(3))]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sets = [plain_set(t) for t in texts]
    near = [(a, b) for b in range(len(texts)) for a in range(b) if jaccard(sets[a], sets[b]) >= 0.8]
    want = {top for top in plain_classes(range(len(texts)), near).values()}
    assert 60 < len(want) < 200
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()} == want


def test_dense_group_in_few_comparisons(spark):
    """Copies of one text become one row, whichever of them is the first."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(400)]
    rows = [(900 - k, " ".join(edited(rng, base, 2))) for k in range(150)]
    kept = nearcopies.first_of_each_class(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [r.doc_id for r in kept] == [751]


def test_edge_cases(edge_docs, no_docs):
    extra = wide(edge_docs, "at", "row", "n", "keys", "root", "node", "digest")
    kept = nearcopies.first_of_each_class(extra)
    assert kept.columns == extra.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids.count(8) == 1 and ids.count(7) == 1 and 102 in ids and not {101, 103, 104} & set(ids)
    assert nearcopies.first_of_each_class(no_docs).count() == 0
