"""Evidence reaches every repeat of an entity, however many there are."""

import numpy as np
import pytest

pytest.importorskip("plainspoke.llm")
from plainspoke.llm import pii  # noqa: E402


def test_evidence_reaches_a_hundred_repeats():
    field = pii.SkipChain()
    field.w[0, 3], field.s = 20.0, 8.0
    g, other = pii.Nodes("5555272 word " * 100), pii.Nodes("5555272 word 5555272")
    assert len(g.skip) == 99 and not g.chain
    g.x[:], other.x[:] = 0, 0
    g.x[0, 0] = 1
    k = field.w.shape[1]
    first = np.exp(field.w[0])
    step = np.exp(field.s * np.eye(k))
    want = [first / first.sum()]
    for _ in range(99):  # a chain is a tree: exact
        want.append(step @ want[-1] / (step @ want[-1]).sum())
    got = field.marginals([other, g, other])
    assert np.abs(got[2:102] - np.array(want)).max() < 1e-3 and got[101][3] > 0.8
    assert np.abs(got[[0, 1, 102, 103]] - 1 / k).max() < 1e-9
    assert np.array_equal(field.marginals([g]), got[2:102])  # whatever else is in the batch
