"""Whitening against numpy's eigenvectors and exact integers; spectrum slicing on matrices with close and equal eigenvalues."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tracelake.llm import queries, whitening

FOLDER = "/root/testdata/sf0.01"


def matrices():
    r = np.random.default_rng(3)
    for d in (1, 2, 7, 40):
        q, _ = np.linalg.qr(r.standard_normal((d, d)))
        yield np.cov(r.standard_normal((d, 3 * d + 2)))
        yield np.diag(np.arange(d, dtype=float))
        for e in (np.ones(d), np.repeat(r.random(d), 3)[:d], 1 + np.arange(d) * 1e-10, np.where(np.arange(d) < d / 2, r.random(d), 0), 10.0 ** -np.arange(d)):
            yield (lambda a: (a + a.T) / 2)(q @ np.diag(e) @ q.T)


@pytest.mark.parametrize("a", [np.atleast_2d(a) for a in matrices()])
def test_leading(a):
    values, vectors = whitening.leading(a, 16)
    want = np.linalg.eigvalsh(a)[::-1][:16]
    size = np.abs(want).max()
    assert np.abs(values - want).max() <= 1e-13 * size
    assert np.abs(vectors @ a - values[:, None] * vectors).max() <= 1e-12 * size
    assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() <= 1e-12


def test_inertia():
    r = np.random.default_rng(4)
    for d in (1, 2, 3, 10, 50):
        for _ in range(20):
            a = r.standard_normal((d, d))
            a = a + a.T if r.random() < 0.5 else np.where(r.random((d, d)) < 0.3, 1.0, 0) + 0
            a = (a + a.T) / 2
            e, shift = np.linalg.eigvalsh(a), float(r.standard_normal())
            assert whitening.inertia(a, shift) == ((e > shift).sum(), 0, (e < shift).sum())
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == (1, 0, 1)
    assert whitening.inertia(np.zeros((3, 3)), 0.0) == (0, 3, 0)


def plain(rows, components=16):
    """vec_id and x of rows to the columns, by exact integers and numpy's eigenvectors."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows}
    fit = np.array(sorted(set(map(tuple, x.values()))), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    z = ((fit * n - s) / n).astype(float)
    e, p = np.linalg.eigh(z.T @ z / n)
    e, p = e[::-1][:components], p[:, ::-1][:, :components]
    out = {}
    for i, v in x.items():
        gap = [n * a - b for a, b in zip(v, s, strict=True)]
        w = np.array([g / n for g in gap]) @ p / np.sqrt(e)
        for k in range(len(e)):
            out[i, k + 1] = (n, sum(g * g for g in gap), w[k], e[k] / np.trace(z.T @ z / n))
    return out


def compare(df, want):
    got = {(r["vec_id"], r["component"]): (r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in df.collect()}
    assert got.keys() == want.keys()
    signs: dict = {}
    for key, (n, deviation, w, explained, error) in got.items():
        assert (n, deviation) == want[key][:2] and explained == pytest.approx(want[key][3], rel=1e-9) and error < 1e-9
        if abs(w) > 1e-6:
            signs.setdefault(key[1], set()).add(w * want[key][2] > 0)
        assert abs(w) == pytest.approx(abs(want[key][2]), rel=1e-6, abs=1e-9)
    assert all(len(s) == 1 for s in signs.values())


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    compare(queries.op12_embedding_whitening(spark, FOLDER), plain(rows))


def test_odd_vectors(spark):
    """Far means, repeated vectors and ids, nulls, entries that are not finite, clashing columns, no rows, one vector."""
    r = np.random.default_rng(5)
    rows = [(i, (r.standard_normal(6) * np.arange(1, 7) + 1e5).tolist()) for i in range(200)]
    rows += [(1000 + i, v) for i, v in rows[:50]] + [(2000, rows[0][1])] * 3
    bad = [(3000, None), (3001, []), (3002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (3003, [math.nan] * 6), (3004, [math.inf] + [0.0] * 5)]
    kind = "vec_id long, embedding array<double>, y string, n int, d int, at int"
    make = lambda rows: spark.createDataFrame([(*x, "y", 1, 2, 3) for x in rows], kind)
    got = whitening.whiten(make(rows + bad).repartition(4))
    assert got.count() == len(rows) * 6
    compare(got, plain(rows))
    assert whitening.whiten(make(bad)).count() == 0 and whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make(rows[:1] * 4)).count() == 0  # no variance, no components
    two = whitening.whiten(make(rows[:2] + [(None, rows[2][1])])).collect()
    assert len(two) == 3 * 2 and {r["component"] for r in two} == {1, 2}
    huge = whitening.whiten(make([(i, [1e300 * (i % 2), float(i), 0.0]) for i in range(4)])).collect()
    assert {r["deviation"] for r in huge} == {None} and {r["component"] for r in huge} == {1}
