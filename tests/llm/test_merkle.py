import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from queuelens.llm import merkle
from .conftest import DOCS, wide


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(hashes):
    """Root of a list of digests and the steps of each."""
    steps, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for own, i in zip(steps, at):
            other = level[i ^ 1] if i ^ 1 < len(level) else ""
            own.append((other, "") if i % 2 else ("", other))
        level = [H(*level[i:i + 2]) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], steps


def brute(rows):
    def leaf(r, n):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, n, r.text)])

    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id, leaf(r, r.n_chars), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: tree([x[1] for x in groups[g]]) for g in order}
    root, tops = tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for (doc_id, digest, r), steps in zip(groups[g], trees[g][1]):
            acc = digest
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and r.n_chars is not None:
                acc = leaf(r, r.n_chars + 1)
            for before, after in steps + top:
                acc = H(before, acc, after)
            out.append((doc_id, digest, trees[g][0], root, H(*[b + a for b, a in steps + top]), acc, acc == root))
    return sorted(out, key=repr)


def found(docs, **how):
    rows = merkle.audited(docs, **how).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof"),
                                              "folded_root").collect()
    return sorted([(*r, r.folded_root == r.root) for r in rows], key=repr)


def test_manifest_of_edge_cases(spark, edge_docs):
    got = found(wide(edge_docs, "grp", "rank", "rows", "hash", "keep", "item", "block"), digits=2)
    assert got == brute(edge_docs.collect())
    assert {r[-1] for r in got} == {True, False}  # altered rows are told, others verify


@pytest.mark.parametrize("sizes, digits", [([1], 9), ([2, 3], 2), ([4, 1], 2), ([33, 16, 17, 1, 5, 8, 9, 64], 2), ([130], 4)])
def test_shapes(spark, sizes, digits):
    rng = random.Random(str(sizes))
    rows = [(rng.randint(-1000, 1000), f"t{rng.randint(0, 9)}", f"l{g}" if g else None, "s", k) for g, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame(rows, DOCS)
    assert found(docs, digits=digits) == brute(docs.collect())


def test_empty_and_given_tables(spark, no_docs, sf_dir):
    assert found(no_docs) == []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(docs) == brute(docs.collect())


def test_rollup_needs_one_exchange_and_no_join(spark, edge_docs):
    nodes = edge_docs.select(F.col("lang").alias("grp"), F.col("n_chars").alias("rank"), F.length("text").cast("bigint").alias("rows"),
                             F.struct(F.md5("text").alias("hash")).alias("item"))
    plan = merkle._rolled(nodes, 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("+- Sort [") == 1 and "Join" not in plan
