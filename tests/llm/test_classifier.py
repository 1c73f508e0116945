"""The quality classifier's passages, forward pass and gradients against plain forms of the same rules."""

from __future__ import annotations

import numpy as np

from tracelake.llm import quality_classifier as qc

TEXTS = ["", "one", "a b a b", " ".join(f"w{k % 50}" for k in range(200)), "Same words, same words. " * 30, "äö " * 65, "   \n\t ", "x" * 5000]


def weights(seed=1):
    r = np.random.default_rng(seed)
    return {k: r.standard_normal(v.shape) * 0.3 for k, v in qc._initial().items()}


def test_passages():
    """Passages of 64 words; the same word or pair has the same row wherever it stands, others mostly other rows."""
    x, count, grams, per = qc.passages(TEXTS)
    words = [t.split() for t in TEXTS]
    assert list(count) == [max(1, -(-len(w) // qc.PASSAGE)) for w in words] and len(x) == len(per) == count.sum()
    cut = [w[a : a + qc.PASSAGE] for w in words for a in range(0, max(1, len(w)), qc.PASSAGE)]
    assert list(per) == [2 * len(c) for c in cut] and len(grams) == per.sum() and grams.min() >= 0 and grams.max() < qc.GRAMS
    rows, at = {}, 0
    for c in cut:
        for a, b in zip(c, [*c[1:], None][: len(c)], strict=True):
            for key, row in ((a, grams[at]), ((a, b), grams[at + 1])):
                assert rows.setdefault(key, row) == row
            at += 2
    assert len(set(rows.values())) > 0.95 * len(rows)


def test_long_texts_in_blocks(monkeypatch):
    r = np.random.default_rng(2)
    table, per = r.standard_normal((qc.GRAMS, 4)), np.array([0, 3, 0, 50, 1, 7, 0])
    grams = r.integers(0, qc.GRAMS, per.sum()).astype(np.int16)
    ends = np.cumsum(per)
    want = [table[grams[e - n : e]].mean(axis=0) if n else np.zeros(4) for e, n in zip(ends, per, strict=True)]
    for block in (1, 5, 1000):
        monkeypatch.setattr(qc, "BLOCK", block)
        assert np.allclose(qc.gram_means(table, grams, per), want)
    assert qc.gram_means(table, grams[:0], np.zeros(0, int)).shape == (0, 4)


def test_forward():
    """Document by document, passage by passage: one layer, gated attention that sums to 1, a logistic output."""
    p, (x, count, grams, per) = weights(), qc.passages(TEXTS)
    logits, (*_, share, _) = qc._forward(p, x, count, grams, per)
    at = gram = 0
    for doc, n in enumerate(count):
        hidden, gates = [], []
        for k in range(at, at + n):
            mean = np.zeros(qc.HIDDEN)
            for g in grams[gram : gram + per[k]]:
                mean += p["g"][g] / per[k]
            gram += per[k]
            h = np.maximum(0, p["w"].T @ x[k] + mean + p["wb"])
            hidden.append(h)
            gates.append(p["a"] @ (np.tanh(p["v"].T @ h) / (1 + np.exp(-(p["u"].T @ h)))))
        a = np.exp(np.array(gates) - max(gates))
        a /= a.sum()
        assert np.allclose(share[at : at + n], a) and np.isclose(logits[doc], sum(w * h for w, h in zip(a, hidden, strict=True)) @ p["c"] + p["cb"][0])
        at += n


def test_gradients():
    p, bags = weights(), qc.passages(TEXTS)
    y, weight = np.array([0, 1, 1, 0, 1, 0, 1, 0.0]), np.linspace(0.5, 2, 8)
    _, g = qc.gradients(p, *bags, y, weight)
    r, step = np.random.default_rng(3), 1e-6
    for name, value in p.items():
        assert g[name].shape == value.shape
        places = [tuple(r.integers(0, n) for n in value.shape) for _ in range(12)]
        if name == "g":
            places = [(int(bags[2][r.integers(len(bags[2]))]), int(r.integers(qc.HIDDEN))) for _ in range(12)] + places[:2]
        for at in places:
            sides = []
            for d in (step, -step):
                moved = value.copy()
                moved[at] += d
                sides.append(qc.gradients(p | {name: moved}, *bags, y, weight)[0])
            assert np.isclose(g[name][at], (sides[0] - sides[1]) / (2 * step), rtol=1e-4, atol=1e-8), (name, at)


def test_learns_from_words_alone():
    """Two kinds of texts with the same characters in the same shares, told apart by their pairs of words; attention finds the passage."""
    r = np.random.default_rng(4)
    filler = [" ".join(r.choice(["abc", "bca", "cab"], 64)) for _ in range(240)]
    good, bad = " ".join(["abcd dcba"] * 32), " ".join(["abdc dcab"] * 32)
    texts = [" ".join([filler[3 * k], good if k % 2 else bad, filler[3 * k + 1]]) for k in range(80)]
    x, count, grams, per = qc.passages(texts)
    y = np.arange(80) % 2
    p = qc.train(x, count, grams, per, y.astype(float), epochs=60)
    logits, (*_, share, _) = qc._forward(p, x, count, grams, per)
    assert ((logits > 0) == y).all() and share.reshape(80, 3)[:, 1].mean() > 0.4
    assert qc.train(x[:0], count[:0], grams[:0], per[:0], y[:0].astype(float))["g"].any() == np.False_
