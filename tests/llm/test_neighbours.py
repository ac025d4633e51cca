import numpy as np
import pytest

from queuelens.llm import neighbours as n

from .conftest import wide


def plain(ids, x, queries, k):
    out = {}
    for q in queries:
        best = {}
        for other in np.flatnonzero(ids != ids[q]):
            score = float(np.multiply(x[q], x[other]).sum())
            best[int(ids[other])] = max(score, best.get(int(ids[other]), -np.inf))
        out[int(ids[q])] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


@pytest.mark.parametrize("case", ["random", "clustered", "copies", "scales"])
def test_blocks_equal_brute_force(case):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 24)).astype(np.float32).astype(float)
    if case == "clustered":
        x = x * 0.01 + rng.normal(size=(3, 24))[rng.integers(0, 3, 700)]
    if case == "copies":
        x[100:400] = x[5]
    if case == "scales":
        x *= 10.0 ** rng.integers(-6, 7, (700, 1))
    ids = np.arange(700)
    queries = ids[::20]
    at, found, scores = n.block_best(ids[queries], x[queries], ids, x, 7)
    want = plain(ids, x, queries, 7)
    for k, q in enumerate(queries):
        assert [(int(f), s) for f, s in zip(found[at == k], scores[at == k])] == want[int(q)]


def test_wide_products_stay_exact():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(-127, 128, (5, 3000)).astype(np.int8) for _ in range(2))
    assert np.array_equal(n.tile_product(a, b), a.astype(np.int64) @ b.astype(np.int64).T)


def test_search_with_edge_cases(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6)).astype(np.float32)
    x[50:60] = x[40]
    rows = [(k, [float(v) for v in x[k]], 0) for k in range(200)]
    rows += [(100, rows[3][1], 0), rows[7], rows[7], (None, rows[1][1], 0), (300, None, 0), (320, [0.0] * 6, 0), (340, [], 0),
             (360, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (380, [float("nan")] * 6, 0), (400, [float("inf")] * 6, 0),
             (420, [1.0, 2.0], 0), (421, [3.0, 1.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    extra = wide(vectors, "qb", "cb", "width", "score")
    got = {}
    for r in n.nearest(extra.where("vec_id % 20 = 0"), extra, 5, query_rows=4, block_rows=30).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    ids = np.array([r[0] for r in rows[:203]])
    full = np.array([r[1] for r in rows[:203]], dtype=np.float32).astype(float)
    want = plain(ids, full, [q for q in range(200) if q % 20 == 0 and q != 100], 5)
    for q, best in want.items():
        assert [(i, s) for _, i, s in sorted(got[q])] == best and [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
    assert got[420] == [(1, 421, 5.0)] and not {300, 320, 340, 360, 380, 400} & set(got)
    assert len({i for _, i, _ in got[100]}) == 5 and 100 not in {i for _, i, _ in got[100]}
    empty = vectors.filter("false")
    assert n.nearest(empty, vectors, 5).count() == 0 and n.nearest(vectors, empty, 5).count() == 0


@pytest.mark.parametrize("low, high", [(-300, -290), (-150, 150), (150, 300), (-300, 300)])
def test_magnitudes_from_the_smallest_to_the_largest(low, high):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)) * 10.0 ** rng.integers(low, high + 1, (300, 1))
    ids = np.arange(300)
    at, found, scores = n.block_best(ids[::10], x[::10], ids, x, 6)
    for k, q in enumerate(ids[::10]):
        every = n.exact_scores(np.repeat(x[q:q + 1], 300, axis=0), x)
        assert not np.isnan(every).any()
        want = sorted(((-every[o], o) for o in ids if o != q))[:6]
        assert [(-s, f) for f, s in zip(found[at == k], scores[at == k])] == want


def test_products_beyond_doubles(spark):
    rows = [(k, [1e200 * (k + 1), 0.0]) for k in range(5)] + [(20, [-1e200, 1e-10]), (40, [1e-10, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in n.nearest(vectors.where("vec_id % 20 = 0"), vectors, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    inf = float("inf")
    assert got[0] == [(1, inf), (2, inf), (3, inf)] and got[40] == [(k, 1e-10 * (1e200 * (k + 1))) for k in (4, 3, 2)]
    assert [i for i, _ in got[20]] == [40, 0, 1] and got[20][1][1] == -inf
