import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from queuelens.llm import whitening

ROWS = "vec_id bigint, embedding array<float>"


def reference(vectors, most=16):
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    v = c.T @ c / n
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1][:most], basis[:, ::-1][:, :most]
    keep = values > 1e-12 * np.trace(v)
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ basis[:, keep] / np.sqrt(values[keep]), values[keep] / np.trace(v)


def check(df, ids, vectors, most=16):
    n, deviation, whitened, explained = reference(vectors, most)
    k = len(explained)
    got = df.orderBy("id", "component").collect()
    assert len(got) == len(ids) * k and {r.n for r in got} == {n}
    order = np.argsort(ids, kind="stable")
    assert [r.deviation for r in got[::k]] == deviation[order].tolist()
    w = np.array([r.whitened for r in got]).reshape(-1, k)
    sign = np.sign((w * whitened[order]).sum(axis=0))
    assert np.abs(w * sign - whitened[order]).max() < 1e-8
    assert np.allclose([r.explained for r in got[:k]], explained, rtol=1e-9)
    assert max(r.identity_error for r in got) < 1e-8


def test_given_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = df.collect()
    check(whitening.whiten(df), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_edges(spark):
    rng = random.Random(2)
    good = [(k, [rng.gauss(0, 1) * (j + 1) for j in range(5)]) for k in range(60)]
    good += [(100 + k, good[0][1]) for k in range(40)]  # copies count once in the fit
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
           (204, []), (205, [1.0] * 4)]
    df = spark.createDataFrame(good + bad, ROWS).select("*", F.lit(1).alias("x"), F.lit(2).alias("id"), F.lit(3).alias("n"))
    check(whitening.whiten(df.repartition(7)), [g[0] for g in good], [g[1] for g in good])
    check(whitening.whiten(df, most=2), [g[0] for g in good], [g[1] for g in good], 2)
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 3):
        assert whitening.whiten(spark.createDataFrame(rows, ROWS)).count() == 0


def test_null_ids_huge_entries_and_flat_dimensions(spark):
    rows = [(None, [float(k), 2.0 * k, 7.0]) for k in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == 9 and {r.component for r in got} == {1} and abs(sum(r.whitened ** 2 for r in got) / 9 - 1) < 1e-9
    huge = [(k, [3e38 * (-1) ** k, float(k)]) for k in range(4)]
    got = whitening.whiten(spark.createDataFrame(huge, ROWS)).collect()
    assert len(got) >= 4 and {r.deviation for r in got} == {None}


@pytest.mark.parametrize("d", [1, 2, 5, 40, 120])
def test_inertia_counts(d):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, d))
    a = a + a.T
    values = np.linalg.eigvalsh(a)
    for s in np.linspace(values[0] - 1, values[-1] + 1, 23):
        assert whitening.inertia_below(a, s) == (values < s).sum()
    assert whitening.inertia_below(np.array([[0.0, 1], [1, 0]]), 0) == 1 and whitening.inertia_below(np.zeros((3, 3)), 0) == 0


@pytest.mark.parametrize("spectrum", [
    np.r_[np.full(8, 7.0), np.linspace(1, 3, 40)], np.geomspace(1e6, 1e-6, 48), np.r_[1 + np.arange(30) * 1e-13, np.zeros(18)],
    np.ones(20), np.r_[5.0, 5.0 - 1e-9, 5.0 - 2e-9, 1.0]])
def test_spectra_with_ties_and_clusters(spectrum):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))[0]
    m = q @ np.diag(spectrum) @ q.T
    values, vectors = whitening.leading_components(m, 16)
    top = spectrum.max()
    assert np.abs(values - np.sort(spectrum)[::-1][:len(values)]).max() < 1e-13 * top
    assert len(values) == min(16, (spectrum > 1e-12 * top).sum())
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(m @ vectors - vectors * values).max() < 1e-12 * top
