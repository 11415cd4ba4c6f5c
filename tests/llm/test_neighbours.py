import math

import numpy as np
import pytest

from spanforge.llm import neighbours as N

DIM = 16
FIELDS = "vec_id long, embedding array<float>, encoded_at timestamp, h string, cos double"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, None, "x", 1.0) for i, e in rows], FIELDS)


def lists(df):
    out = {}
    for r in df.orderBy("vec_id", "position").collect():
        out.setdefault(r.vec_id, []).append(r.near_id)
    return out


def brute(rows, k):
    x = {i: np.asarray(e, np.float32).astype(float) for i, e in rows}
    x = {i: v / np.linalg.norm(v) for i, v in x.items()}
    return {i: sorted((j for j in x if j != i), key=lambda j: (-round(float(x[i] @ x[j]), 6), j))[:k] for i in x}


def test_dirty_rows_and_many_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=DIM).tolist()) for i in range(40)]
    rows += [(50 + i, rows[3][1]) for i in range(12)]  # more copies than are kept
    rows += [(70, [2 * v for v in rows[4][1]])]
    dirty = [(90, None), (91, [0.0] * DIM), (92, [float("nan")] * DIM), (93, [1.0]), (94, [math.inf] + [0.0] * (DIM - 1)), (None, rows[0][1]), (95, [None] * DIM)]
    got, want = lists(N.most_similar(frame(spark, rows + dirty + rows[:5]), k=3, dim=DIM)), brute(rows, 3)
    assert got.keys() == want.keys() and all(len(x) == 3 for x in got.values())
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.95 * 3 * len(want)
    assert all(got[i] == want[i] for i in [3, *range(50, 62)])  # copies: ties to the smaller id


def test_of_one_id_the_latest_counts(spark):
    a, b, c = [1.0] + [0.0] * 15, [0.0, 1.0] + [0.0] * 14, [0.9, 0.1] + [0.0] * 14
    rows = [(1, a, "2025-01-01", "", 0.0), (1, b, "2025-01-02", "", 0.0), (2, b, "2025-01-01", "", 0.0), (3, c, "2025-01-01", "", 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, t string, h string, cos double").selectExpr("vec_id", "embedding", "cast(t as timestamp) encoded_at", "h")
    assert lists(N.most_similar(df, k=1, dim=DIM)) == {1: [2], 2: [1], 3: [1]}


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_vectors(spark, n):
    rows = [(i, [float(i + 1)] + [1.0] * (DIM - 1)) for i in range(n)]
    got = lists(N.most_similar(frame(spark, rows), k=5, dim=DIM))
    assert got == ({0: [1], 1: [0]} if n == 2 else {})


def test_recall_over_many_cells(spark):
    """Groups of uneven size, one with a third of all vectors, over several cells and stripes."""
    rng = np.random.default_rng(2)
    sizes = [1000, 500, *[50] * 20, *[10] * 50]
    centres = rng.normal(size=(len(sizes), DIM))
    x = np.concatenate([c + 0.3 * rng.normal(size=(n, DIM)) for c, n in zip(centres, sizes)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    unit = np.stack([np.asarray(e, np.float32) for _, e in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    plan = N.fit(unit, len(unit), 5, m=8, cell_rows=100, block_rows=100)
    assert len(plan.leaves) > 4 and plan.cells == sum(leaf.tasks for leaf in plan.leaves)
    assert any(leaf.blocks > 2 for leaf in plan.leaves)  # a hot cell, met as pairs of blocks
    ids = np.arange(len(unit))
    row, task, block, data, ask = plan.tasks(unit @ plan.axes, ids)
    assert len(set(zip(row, task))) == len(row) and len(set(row[data])) == len(unit) and task.max() < plan.cells
    found = {}
    for c in range(plan.cells):
        here = task == c
        for b in np.unique(block[here & data]):
            own, asking = row[here & data & (block == b)], row[here & ask & ((b >= 0) | (block != b))]
            if len(asking):
                for q, i, s in zip(*N.search(plan, 1.0, ids[own], unit[own], unit[asking], 6)):
                    found.setdefault(asking[q], []).append((-s, i))
    assert all(len({i for _, i in x}) == len(x) for x in found.values())  # no pair is met twice
    cos = np.round(unit.astype(float) @ unit.T.astype(float), 6)
    np.fill_diagonal(cos, -2)
    hit = 0
    for q in range(len(unit)):
        best = set(np.lexsort((ids, -cos[q]))[:5])
        hit += len(best & {i for _, i in sorted(x for x in found.get(q, []) if x[1] != q)[:5]})
    assert hit / 5 / len(unit) > 0.95


def test_pairs(spark):
    df = spark.createDataFrame([(2, 1), (1, 2), (3, 1)], "vec_id long, near_id long")
    assert sorted(map(tuple, N.pairs(df).collect())) == [(1, 2), (1, 3)]


def test_collisions_are_those_of_each_query():
    """The vectors verified for a query are those in enough of its own windows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, DIM)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plan = N.fit(x, len(x), 5, m=8, threshold=5)
    plan.width = np.full(8, 0.2, np.float32)
    h, q = x @ plan.axes, (x @ plan.axes)[:40]
    some, hits = N.Arrays(plan, x).collisions(q, plan.width, plan.threshold)
    low, high = q - plan.width, q + plan.width
    count = ((h[None] >= low[:, None]) & (h[None] <= high[:, None])).sum(2)
    want = count >= 5
    assert 0 < want.sum() < want.size and (hits == want[:, some]).all() and not np.delete(want, some, axis=1).any()
    for i in range(40):
        _, near, _ = N.search(plan, 1.0, np.arange(700), x, x[i : i + 1], 700)
        assert set(near) == set(np.flatnonzero(want[i]))


@pytest.mark.parametrize(("blocks", "visitors"), [(1, 1), (1, 3), (3, 1), (4, 3)])
def test_each_pair_of_a_hot_cell_is_met_once(blocks, visitors):
    leaf = N.Leaf(10, blocks, visitors)
    other = N.Leaf(10 + leaf.tasks, 1, 1)
    cut = (np.array([1.0], np.float32), 0.0, 0.5, 1, 2)
    plan = N.Plan(np.eye(1), np.ones(1), 1.0, 1, [cut, (None, 0), (None, 1)], [leaf, other], 10 + leaf.tasks + 1)
    proj, h = np.concatenate([np.full(40, -2.0), np.full(25, 0.1)])[:, None].astype(np.float32), np.arange(65) * 7
    row, task, block, data, ask = plan.tasks(proj, h)
    met = {}
    for c in np.unique(task):
        here = task == c
        assert 10 <= c < plan.cells
        for b in np.unique(block[here & data]):
            for q in row[here & ask & ((b >= 0) | (block != b))]:
                for d in row[here & data & (block == b)]:
                    met[q, d] = met.get((q, d), 0) + 1
    asked = {(q, d) for q in range(65) for d in range(40)} | {(q, d) for q in range(40, 65) for d in range(40, 65)}
    assert set(met) == asked and set(met.values()) == {1}


def test_open_queries_are_answered_by_wider_windows(spark):
    """Vectors far from all others are beyond the windows of the many near ones."""
    rng = np.random.default_rng(4)
    x = np.concatenate([c + 0.05 * rng.normal(size=(20, DIM)) for c in rng.normal(size=(60, DIM))] + [rng.normal(size=(9, DIM))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = lists(N.most_similar(frame(spark, rows), k=4, dim=DIM)), brute(rows, 4)
    assert all(len(v) == 4 for v in got.values()) and got.keys() == want.keys()
    assert sum(len(set(got[i]) & set(want[i])) for i in range(1200, 1209)) >= 34
