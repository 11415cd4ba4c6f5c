import itertools
import random

import pytest

from spanforge.llm import borda as B
from spanforge.llm import distinctive as T
from spanforge.runtime import join_totals

S = "question_id string, scorer string, chunk_id long, score double, scored_at timestamp, points string, n int"


def scores(spark, rows):
    return spark.createDataFrame([(q, s, c, x, None, "p", 1) for q, s, c, x in rows], S)


def scorers(spark, up=(("a", True), ("b", False), ("a", True))):
    return spark.createDataFrame(list(up), "scorer string, higher_is_better boolean")


def brute(rows, up):
    """Points with missing scores sharing the last places."""
    out = {}
    for q in {r[0] for r in rows}:
        cand = {r[2] for r in rows if r[0] == q}
        total = dict.fromkeys(cand, 0.0)
        for s in {r[1] for r in rows if r[0] == q}:
            have = {c: x if up.get(s, True) else -x for qq, ss, c, x in rows if (qq, ss) == (q, s) and x is not None and x == x}
            if not have:
                continue
            for c in cand:
                if c in have:
                    place = sum(v > have[c] for v in have.values()) + (sum(v == have[c] for v in have.values()) + 1) / 2
                else:
                    place = (len(have) + 1 + len(cand)) / 2
                total[c] += len(cand) - place
        out[q] = total
    return out


@pytest.mark.parametrize("group_rows", [20_000, 3])
def test_borda_against_brute_force(spark, group_rows):
    rnd = random.Random(3)
    rows = [(q, s, c, rnd.choice([None, float("nan"), float("inf"), 1.0, 2.0, 1e9, rnd.random()])) for q, s, c in itertools.product("xyz", "ab", range(12)) if rnd.random() < 0.8]
    got = {}
    for r in B.borda(scores(spark, rows + rows[:6]), scorers(spark), group_rows=group_rows).collect():
        got.setdefault(r.question_id, {})[r.chunk_id] = r.points
    assert got == {q: {c: pytest.approx(p) for c, p in x.items()} for q, x in brute(rows, {"b": False}).items()}


def test_crowded_ties_and_weights(spark):
    """Many equal scores in a large group, and a scorer that counts twice."""
    rnd = random.Random(8)
    rows = [("x", "a", c, float(rnd.choice([1, 1, 1, 2, 3]))) for c in range(40)] + [("x", "b", c, float(c % 7)) for c in range(0, 60, 2)] + [("y", "a", 1, 2.0)]
    up = {"b": False}
    got = {(r.question_id, r.chunk_id): r.points for r in B.borda(scores(spark, rows), scorers(spark), {"a": 2.0}, group_rows=5).collect()}
    once, twice = brute(rows, up), brute([r for r in rows if r[1] == "a"], up)
    extra = lambda q, c: twice[q].get(c, len(once[q]) - (len(twice[q]) + 1 + len(once[q])) / 2) + (len(once[q]) - len(twice[q]) if c in twice[q] else 0)
    assert got == {(q, c): pytest.approx(p + extra(q, c)) for q, x in once.items() for c, p in x.items()}


def test_plan_is_short(spark):
    df = B.leading(B.borda(scores(spark, [("q", "a", c, 1.0) for c in range(9)]), scorers(spark)), 3)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 6


def test_borda_latest_usable_and_edges(spark):
    rows = spark.createDataFrame(
        [("q", "a", 1, 5.0, "2025-01-01"), ("q", "a", 1, 1.0, "2025-01-02"), ("q", "a", 1, None, "2025-01-03"), ("q", "a", 2, 3.0, "2025-01-01"), (None, "a", 1, 1.0, "2025-01-01"), ("q", "a", None, 1.0, "2025-01-01"), ("q", None, 3, 9.0, "2025-01-01")],
        "question_id string, scorer string, chunk_id long, score double, scored_at string",
    ).selectExpr("question_id", "scorer", "chunk_id", "score", "cast(scored_at as timestamp) scored_at")
    ranked = B.leading(B.borda(rows, scorers(spark)), 3).orderBy("position").collect()
    assert [r.chunk_id for r in ranked] == [2, 1, 3]
    assert B.borda(rows.limit(0), scorers(spark)).count() == 0
    assert B.borda(rows, scorers(spark, [("z", None)]).limit(0)).count() == 3


def test_ties_go_to_the_smaller_chunk(spark):
    df = B.borda(scores(spark, [("q", "a", c, 1.0) for c in (3, 1, 2)]), scorers(spark))
    assert [r.chunk_id for r in B.leading(df, 2).orderBy("position").collect()] == [1, 2]


P = "chunk_id long, term string, tf long, indexed_at timestamp, df int, weight string"


def postings(spark, rows):
    return spark.createDataFrame([(c, t, n, None, 1, "w") for c, t, n in rows], P)


def test_residuals_against_brute_force(spark):
    rows = [(1, "self", 5), (1, " Rare ", 5), (1, "rare", 2), (2, "self", 5), (2, "rare", 1), (3, "self", 5), (3, "only", 9), (4, None, 1), (4, " ", 1), (4, "x", 0), (4, "x", None), (4, "x", -1), (None, "self", 3)]
    got = {(r.chunk_id, r.term): r.weight for r in T.residuals(postings(spark, rows)).collect()}
    table = {(1, "self"): 5, (1, "rare"): 5, (2, "self"): 5, (2, "rare"): 1, (3, "self"): 5, (3, "only"): 9}
    n = sum(table.values())
    want = {}
    for (c, t), o in table.items():
        row, col = (sum(v for k, v in table.items() if k[i] == x) for i, x in ((0, c), (1, t)))
        e = row * col / n
        if t != "only":
            want[c, t] = pytest.approx((o - e) / (e * (1 - row / n) * (1 - col / n)) ** 0.5)
    assert got == want
    top = {r.chunk_id: r.term for r in T.top_term(T.residuals(postings(spark, rows))).collect()}
    assert top[1] == "rare" and 4 not in top
    assert T.residuals(postings(spark, rows).limit(0)).count() == 0


def test_hot_terms_and_chunks_give_the_same(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(c, t, rnd.randint(1, 9)) for c in range(30) for t in ["self", *(f"t{rnd.randrange(40)}" for _ in range(20 if c == 3 else 4))]]
    plain = {(r.chunk_id, r.term): r.weight for r in T.residuals(postings(spark, rows)).collect()}
    monkeypatch.setattr(T, "join_totals", lambda a, b, k, n: join_totals(a, b, k, n, limit=5))
    assert {(r.chunk_id, r.term): r.weight for r in T.residuals(postings(spark, rows)).collect()} == plain


def test_latest_count_and_ties(spark):
    rows = [(1, "a", 9, "2025-01-01"), (1, "A", 1, "2025-01-02"), (1, "b", 1, "2025-01-01"), (2, "a", 1, "2025-01-01"), (2, "b", 1, "2025-01-01")]
    df = spark.createDataFrame(rows, "chunk_id long, term string, tf long, t string").selectExpr("chunk_id", "term", "tf", "cast(t as timestamp) indexed_at")
    assert {(r.chunk_id, r.term): r.tf for r in T.clean_postings(df).collect()}[1, "a"] == 1
    assert {r.term for r in T.top_term(T.residuals(df)).collect()} == {"a"}
