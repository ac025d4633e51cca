import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from queuelens.llm import packing, tokenfile
from queuelens.llm.bpe import Encoder

from .conftest import wide

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "Bc", "dé", "ß", "1", "²", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x85", " ", " ", "'s",
          "'", "'ll", "!!", "***", ",", ".", "_", "-", "á", "中文", "😀", "​", "<|endoftext|>", "Ⅷ", "ǅ", "ª"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=5))
def test_encoder_equals_library(texts):
    small = Encoder.of(PATH)
    assert small.encode(texts) == small.plain(texts)


def test_added_tokens_are_as_the_library_has_them(library):
    texts = ["<|endoftext|>", "one <|endoftext|> two", "one<|endoftext|>\ntwo", "<|endoftext", "plain words only"]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in Encoder.of(PATH).encode(texts)] == [library(t) for t in texts]
    assert library(texts[1]).count(50256) == 1


def test_texts_of_the_table_are_as_the_library_has_them(spark, library, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += [t.replace(" ", "  ", 3) + "<|endoftext|>" for t in texts[:50]]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in Encoder.of(PATH).encode(texts)] == [library(t) for t in texts]


def test_encoder_with_a_full_memory():
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcé,.'", k=rng.randint(1, 6))) for _ in range(40)) for _ in range(60)]
    tight = Encoder(PATH, most_cached=50)
    for at in range(0, 60, 7):
        assert tight.encode(texts[at:at + 7]) == tight.plain(texts[at:at + 7])
    assert len(tight.words) == 50


def test_a_look_up_costs_the_same_with_many_known_words():
    rng = random.Random(6)
    many, few = Encoder(PATH), Encoder(PATH)
    many.encode([" ".join("".join(rng.choices("abcdefgh", k=8)) for _ in range(150_000))])
    assert len(many.words) > 140_000
    few.encode(["a few words"])

    def cost(encoder):
        start = time.process_time()
        for _ in range(100):
            encoder.encode(["a few words"])
        return time.process_time() - start

    cost(few), cost(many)
    assert min(cost(many) for _ in range(3)) < 5 * min(cost(few) for _ in range(3)) + 0.1


def test_new_words_are_encoded_many_at_a_time(library):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcé,.'1中", k=rng.randint(1, 5))) for _ in range(1000)]
    texts = [words[0], " ".join(words), "\n".join(words[:300]), "x\ny", " ".join(words[:101])]
    encoder, calls = Encoder(PATH), []
    plain = encoder.plain
    encoder.plain = lambda texts: calls.append(len(texts)) or plain(texts)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == [library(t) for t in texts]
    assert sum(calls) < len(set(words)) / 20


def check_files(spark, docs, library):
    path = tokenfile.write_tokens(docs, PATH, 2)
    files = tokenfile.read_tokens(spark, path)
    got = tokenfile.starts(tokenfile.checksums(files), files).collect()
    assert len(got) == docs.count()
    want = defaultdict(list)
    for r in docs.collect():
        ids = np.array([*library(r.text), 2], "<u4")
        want[r.doc_id].append((len(ids), zlib.crc32(ids)))
    at, last = 0, None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (last is None or (r.doc_id is not None and r.doc_id >= last))
        assert (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
        last = r.doc_id
    return files


def test_token_files_round_trip(spark, edge_docs, no_docs, library):
    files = check_files(spark, wide(edge_docs, "part", "tokens", "n_tokens", "tie"), library)
    one = files.filter("doc_id = 5").select("doc_id", "n_tokens")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "tokens" not in plan.split("ReadSchema")[1] .replace("n_tokens", "") and "EqualTo(doc_id,5)" in plan
    assert check_files(spark, no_docs, library).count() == 0


def test_plan_uses_every_piece_once():
    rng = random.Random(5)
    for length in (16, 64, 2048):
        histogram = {rng.randint(1, length): rng.randint(1, 500) for _ in range(40)} | {1: 3, length: 7}
        patterns = packing.plan(histogram, length)
        used = defaultdict(int)
        for items, packs in patterns:
            assert sum(size * times for size, times in items) <= length and packs > 0
            for size, times in items:
                used[size] += times * packs
        assert dict(used) == histogram and len(patterns) <= 2 * len(histogram)
        # the shortest pack takes the piece: a new pack is opened only if no open one has room
        slack = [length - sum(s * t for s, t in items) for items, _ in patterns]
        opened = [items[0][0] for items, _ in patterns]
        assert all(max(slack) < max(opened) or s <= max(opened) for s in slack)
    assert packing.plan({}, 8) == [] and packing.rank_ranges([]) == []


def check_packing(spark, docs, library, length):
    pieces, assignment = packing.packed(docs, PATH, 1, length)
    rows = pieces.join(assignment, "piece_id").collect()
    assert len(rows) == pieces.count() == len({r.piece_id for r in rows})
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, list(r.tokens)))
    flat = {}
    for key, parts in sequences.items():
        at = 0
        for offset, ids in sorted(parts):
            assert offset == at
            at += len(ids)
        assert at <= length
        flat[key] = [t for _, ids in sorted(parts) for t in ids]
    assert {r.sequence_id: list(r.tokens) for r in packing.sequences(pieces, assignment).collect()} == flat
    made = sorted(tuple(r.tokens) for r in rows)
    want = []
    for r in docs.collect():
        ids = [*library(r.text), 1]
        want += [tuple(ids[k:k + length]) for k in range(0, len(ids), length)]
    assert made == sorted(want)
    return sequences


def test_packing_edge_cases(spark, edge_docs, no_docs, library):
    sequences = check_packing(spark, wide(edge_docs, "id", "piece_id", "length", "part"), library, 256)
    short = sum(256 - sum(len(x) for _, x in parts) for parts in sequences.values())
    assert short < 0.02 * 256 * len(sequences)
    assert check_packing(spark, no_docs, library, 256) == {}
