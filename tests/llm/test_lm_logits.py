"""The softmax layers of op10's model, a row for each output."""

from __future__ import annotations

import numpy as np
import pytest

from tracelake.llm import lm_scoring


def test_logits_by_output():
    r = np.random.default_rng(5)
    s, w, b = r.standard_normal((7, 4)), r.standard_normal((9, 4)), r.standard_normal(9)
    got, want = lm_scoring._logits(s, w, b), s @ w.T + b
    assert got.shape == (9, 7) and got.max(axis=0) == pytest.approx(0)
    assert got.T == pytest.approx(want - want.max(axis=1, keepdims=True))
