"""Ties of vectors of one direction and different lengths."""

import numpy as np

from spanforge.llm import neighbours as N
from test_neighbours import brute, frame, lists

DIM = 16


def scaled(n, rng):
    one = rng.normal(size=DIM)
    return [(1000 - i, (one * (0.1 + 0.37 * i)).tolist()) for i in range(n)] + [(2000 + i, rng.normal(size=DIM).tolist()) for i in range(60)]


def test_copies_of_different_lengths(spark):
    rows = scaled(100, np.random.default_rng(5))
    got, want = lists(N.most_similar(frame(spark, rows), k=5, dim=DIM)), brute(rows, 5)
    assert all(got[i] == want[i] for i in range(901, 1001))


def test_search_compares_all_that_tie():
    rng = np.random.default_rng(6)
    rows = scaled(300, rng)
    ids = np.array([i for i, _ in rows])
    x = np.stack([np.asarray(e, np.float32) for _, e in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, near, cos = N.search(N.fit(x, len(x)), float("inf"), ids, x, x, 6)
    assert all(near[q == i].tolist() == list(range(701, 707)) and set(cos[q == i]) == {1.0} for i in range(300))
