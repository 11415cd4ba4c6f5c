"""Cells that a query visits hold nearly all of its neighbours, however deep the cuts."""

import numpy as np
import pytest

from spanforge.llm import neighbours as N


@pytest.mark.parametrize(("noise", "leaves"), [(0.3, 1), (0.12, 8), (0.05, 8)])
def test_near_vectors_beyond_one_cut(noise, leaves):
    """Groups that overlap everywhere are not cut; others are, and lose nothing by it."""
    rng = np.random.default_rng(7)
    x = np.concatenate([c + noise * rng.normal(size=(12, 16)) for c in rng.normal(size=(250, 16))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plan = N.fit(x, len(x), 5, m=8, cell_rows=60, block_rows=1000)
    assert len(plan.leaves) >= leaves
    proj = x @ plan.axes
    home = np.empty(len(x), int)
    row, leaf = plan.route(proj, 0.0)
    home[row] = leaf
    row, leaf = plan.route(proj, 1.0)
    visited = set(zip(row, leaf))
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    top = np.argsort(-cos, axis=1)[:, :5]
    near = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(cos, top, 1))) <= plan.reach  # what windows of radius 1 vouch for
    seen = np.array([[(q, home[t]) in visited for t in top[q]] for q in range(len(x))])
    assert seen[near].mean() > 0.998
