import random

import numpy as np
import pytest
import xxhash

from queuelens.llm import simhash

from .conftest import wide


def plain_fingerprint(text, shingle=4):
    words = simhash.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[k:k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(items, links):
    root = {i: i for i in items}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in items}


def near(rng, bases, n, flips):
    out = set()
    while len(out) < n:
        key = rng.choice(bases)
        for _ in range(rng.randint(0, flips)):
            key ^= 1 << rng.randint(0, 63)
        out.add(key)
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_trie_join_equals_all_pairs(seed):
    rng = random.Random(seed)
    keys = near(rng, [rng.getrandbits(64) for _ in range(4)], 250, 9)
    links = [(i, j) for j in range(len(keys)) for i in range(j)
             if (keys[i] ^ keys[j]).bit_count() <= 4 and keys[i] >> 51 == keys[j] >> 51]
    want = plain_classes(range(len(keys)), links)
    got = simhash.trie_classes(np.array(keys, np.uint64), 13, 4)
    assert got.tolist() == [want[k] for k in range(len(keys))]


@pytest.mark.parametrize("how", [{}, {"group_rows": 50, "split_rows": 20, "split_bits": 5}])
def test_classes_equal_all_pairs(spark, how):
    rng = random.Random(11)
    keys = near(rng, [rng.getrandbits(64) for _ in range(5)], 300, 7)
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    links = simhash.class_links(spark.createDataFrame([(k,) for k in signed], "fp bigint"), 4, **how)
    roots = {r.node: r.root for r in simhash.connected_classes(links).collect()}
    want = plain_classes(signed, [(signed[i], signed[j]) for j in range(len(keys)) for i in range(j)
                                  if (keys[i] ^ keys[j]).bit_count() <= 4])
    assert {k: roots.get(k, k) for k in signed} == want


def test_documents_and_edge_cases(spark, edge_docs, no_docs):
    got = simhash.near_duplicate_classes(wide(edge_docs, "fp", "component_id", "root")).collect()
    rows = edge_docs.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp % 2**64) for r in got) == sorted(
        (r.doc_id is None, r.doc_id or 0, plain_fingerprint(r.text)) for r in rows)
    ids = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert ids[103] == 102 and ids[101] == 100 and ids[104] == 100 and ids[7] == 7
    assert simhash.near_duplicate_classes(no_docs).count() == 0


def test_first_of_each_class_keeps_whole_rows(edge_docs, no_docs):
    extra = wide(edge_docs, "at", "row", "fp", "root")
    kept = simhash.first_of_each_class(extra)
    assert kept.columns == extra.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids.count(8) == 1 and ids.count(7) == 1 and 102 in ids and not {101, 103, 104} & set(ids)
    assert simhash.first_of_each_class(no_docs).count() == 0
