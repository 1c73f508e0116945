"""Near-dedup of embeddings against all pairs; the estimate's bias and bounds; components against a plain union-find."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tracelake.llm import binary_codes, queries
from tracelake.llm.common import components

FOLDER = "/root/testdata/sf0.01"


def plain_components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "cycle", "none"])
def test_components(spark, kind):
    r = random.Random(7)
    ids = r.sample(range(10**9), 300)
    pairs = {"chain": list(zip(sorted(ids), sorted(ids)[1:], strict=False)), "star": [(ids[0], x) for x in ids], "cycle": list(zip(ids, ids[1:] + ids[:1], strict=True)), "none": [(5, 5)],
             "random": [tuple(r.sample(ids, 2)) for _ in range(170)]}[kind]
    want = plain_components({x for p in pairs for x in p}, pairs) if kind != "none" else {}
    df = spark.createDataFrame([*pairs, *pairs[:3], (None, 4)], "a long, b long")
    got = components(df).collect()
    assert {r["node"]: r["label"] for r in got} == want and len(got) == len(want)


def test_estimates():
    """Unbiased over rotations, and pairs at the threshold stay within the bound."""
    r = np.random.default_rng(0)
    for d in (16, 64, 100):
        x = binary_codes._unit(r.standard_normal((400, d)))
        noise = binary_codes._unit((n := r.standard_normal((400, d))) - (n * x).sum(axis=1, keepdims=True) * x)
        y = 0.95 * x + math.sqrt(1 - 0.95**2) * noise
        a, b = binary_codes.Codes.of(x), binary_codes.Codes.of(y)
        off = np.diag(a.estimates(b)) - 0.95
        wide = np.diag(a.spread(b, 0.95))
        assert abs(off.mean()) < 4 * off.std() / math.sqrt(len(off)) + 0.003
        assert 0.7 < off.std() / wide.mean() < 1.3
        assert np.diag(a.possible(b, 0.95)).mean() >= 0.995
        assert binary_codes.Codes.of(x).possible(binary_codes.Codes.of(r.permutation(noise)), 0.95).mean() < (0.3 if d < 60 else 0.01)


def plain(rows, threshold=0.95):
    """vec_id, n_links, component_id, kept of (vec_id, vector) rows by all pairs."""
    use = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    links, pairs = [0] * len(rows), []
    by: dict = {}
    for k in use:
        by.setdefault(len(rows[k][1]), []).append(k)
    for ks in by.values():
        x = np.array([rows[k][1] for k in ks], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= threshold
        for a, k in enumerate(ks):
            links[k] = int(near[a].sum()) - 1
        pairs += [(ks[a], ks[b]) for a, b in zip(*np.nonzero(near), strict=True) if a < b]
    root = plain_components(range(len(rows)), pairs)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    return [(i, links[k], None if i is None else least[root[k]], i is not None and least[root[k]] == i) for k, (i, _) in enumerate(rows)]


def key(t):
    return (t[0] is None, t[0] or 0, *map(str, t[1:]))


def got(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=key)


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    assert got(queries.op13_embedding_dedup(spark, FOLDER)) == sorted(plain(rows), key=key)


def test_recall_at_the_threshold(spark):
    """Clusters, chains and pairs just above and below 0.95, in plain and in large groups that are cut into blocks."""
    r = np.random.default_rng(2)
    rows = []
    for c in (0.951, 0.955, 0.97, 0.949, 0.94):
        x = binary_codes._unit(r.standard_normal((300, 32)))
        noise = binary_codes._unit((n := r.standard_normal((300, 32))) - (n * x).sum(axis=1, keepdims=True) * x)
        rows += list(x) + list(c * x + math.sqrt(1 - c * c) * noise)
    centre = r.standard_normal(32)
    rows += list(centre + 0.03 * r.standard_normal((1500, 32))) + list(centre + 0.25 * r.standard_normal((400, 32)))
    rows = [(i, (v * 10.0 ** r.integers(-3, 4)).tolist()) for i, v in enumerate(rows)]
    want = {i: (n, c) for i, n, c, _ in plain(rows)}
    out = {i: (n, c) for i, n, c, _ in got(binary_codes.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))}
    assert out.keys() == want.keys()
    assert all(out[i][0] <= want[i][0] for i in want)  # nothing below the threshold links
    assert sum(n for n, _ in out.values()) >= 0.999 * sum(n for n, _ in want.values())
    assert sum(out[i] == want[i] for i in range(3000)) >= 0.997 * 3000


def test_odd_vectors(spark):
    """Nulls, zeros, other sizes, copies, repeated ids, rows without id, clashing columns, no rows."""
    r = np.random.default_rng(3)
    v = r.standard_normal((40, 12)).tolist()
    rows = [(i, x) for i, x in enumerate(v)] + [(100 + i, v[0]) for i in range(30)] + [(7, v[3]), (7, v[7]), (7, v[9]), (None, v[3]), (None, None)]
    rows += [(200, None), (201, []), (202, [0.0] * 12), (203, [math.nan] * 12), (204, [1.0, None]), (205, [math.inf, 1.0]), (206, [1e200, 1e200]), (207, [1e-200, 1e-200]), (208, [1.0, 0.0]), (209, [-0.0, 1.0]), (210, [0.0, 2.0]), (211, [3.0])]
    make = lambda rows: spark.createDataFrame([(*x, "n", 1, 2) for x in rows], "vec_id long, embedding array<double>, node string, copies int, label int").repartition(3)
    scale = lambda x: None if x is None else [c and c / max(abs(z or 0) for z in x) if c is not None and math.isfinite(c) else c for c in x]
    assert got(binary_codes.near_duplicates(make(rows))) == sorted(plain([(i, scale(x)) for i, x in rows]), key=key)
    assert got(binary_codes.near_duplicates(make([]))) == []
