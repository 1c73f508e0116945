"""Neighbours of vectors of like direction: ties and near ties as brute force has them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tracelake.llm import ann_curves, line_dedup


def test_multiples_of_one_vector(spark):
    r = np.random.default_rng(0)
    base = r.standard_normal(24)
    rows = [(i, (base * (i + 1) * 0.37).tolist()) for i in range(60)] + [(100 + i, r.standard_normal(24).tolist()) for i in range(40)]
    x = np.array([v for _, v in rows])
    ids = [i for i, _ in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for q in ann_curves.nearest(df, F.col("vec_id") % 10 == 0).orderBy("rank").collect():
        got.setdefault(q["query_id"], []).append((q["vec_id"], q["score"]))
    assert all(s <= 1 for found in got.values() for _, s in found)
    for a, i in enumerate(ids):
        if i % 10 == 0:
            score = ann_curves.cosines(x, np.full(len(x), a), np.arange(len(x)))
            want = sorted((b for b in range(len(x)) if b != a), key=lambda b: (-score[b], ids[b]))[:5]
            assert got[i] == [(ids[b], score[b]) for b in want]


def test_lines_of_rows_that_share_an_id(spark):
    """A line goes for a line of its own row or of another document, never because another row of its id had a copy."""
    same = "a line of some length that several documents have in common, word for word"
    rows = [(1, same), (2, f"{same}\nsecond line"), (2, "completely other text of the second row of two\nand more of it")]
    out = {r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {same, "second line", "completely other text of the second row of two\nand more of it"}
