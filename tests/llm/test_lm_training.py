"""Baum-Welch counts of whole texts against the plain forward-backward recursion."""

import numpy as np
import pytest

from serion.llm import lm_scoring as lm


def _plain(m, x):
    """(starts, moves, emissions) of one text, step by step."""
    n, s = len(x), lm.STATES
    ahead, back = np.zeros((n, s)), np.ones((n, s))
    for t in range(n):
        ahead[t] = (ahead[t - 1] @ m.move if t else m.start) * m.emit[x[t]]
        ahead[t] /= ahead[t].sum()
    for t in range(n - 2, -1, -1):
        back[t] = m.move @ (m.emit[x[t + 1]] * back[t + 1])
        back[t] /= back[t].sum()
    share = ahead * back
    share /= share.sum(1, keepdims=True)
    moves, emits = np.zeros((s, s)), np.zeros((lm.CLASSES, s))
    for t in range(1, n):
        pair = ahead[t - 1][:, None] * m.move * (m.emit[x[t]] * back[t])[None]
        moves += pair / pair.sum()
    np.add.at(emits, x, share)
    return share[0], moves, emits


@pytest.mark.parametrize("segment", [512, 64, 1])
def test_counts_of_whole_texts(segment, monkeypatch):
    """Cuts change nothing: a text of 1,030 tokens, one that ends with a segment, one of one token."""
    monkeypatch.setattr(lm, "SEGMENT", segment)
    rng = np.random.default_rng(5)
    emit = rng.random((lm.CLASSES, lm.STATES)) ** 4
    model = lm.Model(rng.dirichlet(np.ones(lm.STATES)), rng.dirichlet(np.full(lm.STATES, 0.3), lm.STATES) + 1e-6, emit / emit.sum(0))
    texts = [rng.integers(0, lm.CLASSES, n).astype(np.uint16) for n in (1030, 1, 512, 513, 7, 64)]
    want = [sum(x) for x in zip(*[_plain(model, x) for x in texts], strict=True)]
    for a, b in zip(lm.expected_counts(model, texts), want, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)
