"""Searches of chunks that have no index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import index as X
from spanforge.operators import retrieval as R

COLUMNS = ("question_id", "chunk_id", "score", "rank")


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(500):
        words = [f"w{j}x" for j in np.minimum(rng.geometric(0.08, 12), 60)]
        heading = [None, "", "The w3x of createdThings w7x"][i % 3]
        rows.append((i, f"src/w{i % 9}x/f_{i % 4}." + ("py", "md", "rst")[i % 3], " ".join(words if i % 5 else ["w1x", "w2x"]), heading))
    rows += [(500, None, None, None), (501, "a.py", "", None), (502, "a.md", "é ünï x", ""), (7, rows[7][1], "w4x again", None)]
    return spark.createDataFrame(rows, "chunk_id long, file_path string, text string, context string").withColumns({"first": F.lit(0), "last": F.lit(9)}).repartition(3)


@pytest.fixture(scope="module")
def questions(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{j}x" for j in rng.integers(1, 60, 4))) for i in range(40)] + [(40, "w2x created_things"), (41, "nothing"), (42, None)]
    return spark.createDataFrame(rows, "question_id long, question string")


def test_asked_counts_are_term_counts(chunks, monkeypatch):
    monkeypatch.setattr(X, "ASKED_ROWS", 3)  # rows of one chunk_id come in different parts
    asked = ["thing", "w1x", "created", "none", "w4x"]
    counted = X.term_counts(chunks, lengths=True)
    want = {(r["chunk_id"], r["term"]): (r["tf"], r["doc_len"]) for r in counted.where(F.col("term").isin(asked)).collect()}
    got = {}
    rows = X.asked_counts(chunks, asked).collect()
    for r in rows:
        for code, tf in zip(np.frombuffer(r["codes"], np.int32), np.frombuffer(r["tfs"], np.int32)):
            assert (r["chunk_id"], asked[code]) not in got
            got[r["chunk_id"], asked[code]] = (tf, r["doc_len"])
    assert got == want and len(rows) == chunks.count()
    assert {r["chunk_id"]: r["doc_len"] for r in rows} == {500: 0, 501: 0, 502: 0} | {r["chunk_id"]: r["doc_len"] for r in counted.collect()}


@pytest.mark.parametrize("typed,k,k1,b", [(None, 5, 0.9, 0.4), ("docs", 10, 1.2, 0.75), ("code", 100, 1.2, 0.75), (None, 0, 1.2, 0.75)])
def test_rows_are_those_of_an_index(chunks, questions, monkeypatch, typed, k, k1, b):
    kind = F.when(F.col("question_id") % 3 > 0, F.lit(typed)) if typed else None
    unique = chunks.where("text is null or text <> 'w4x again'")
    want = R.bm25_search(X.build_index(unique), questions, k, k1, b, kind, few=True)
    monkeypatch.setattr(R, "CHUNK_BLOCK", 300)
    for limit in (500_000, 90, 50):  # one block of questions, two, and more terms than are broadcast
        monkeypatch.setattr(R, "BROADCAST_TERMS", limit)
        got = R.search_texts(unique, questions, k, k1, b, kind)
        assert sorted(map(tuple, got.select(*COLUMNS).collect())) == sorted(map(tuple, want.select(*COLUMNS).collect()))


def test_nothing_asked_and_nothing_there(chunks, questions):
    assert R.search_texts(chunks, questions.where("question_id > 40")).count() == 0
    assert R.search_texts(chunks.limit(0), questions).count() == 0


@pytest.mark.parametrize("name", ["bm25_custom_k1b", "bm25_topk_docs", "prompt_build"])
def test_a_search_of_the_tables_writes_no_postings(spark, monkeypatch, name):
    """A query over the tables built the whole index first, all postings of all terms."""
    import os

    from spanforge.plans import catalog

    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no tables here")

    def refuse(*_, **__):
        raise AssertionError("postings were written")

    monkeypatch.setattr(X, "term_counts", refuse)
    monkeypatch.setattr(catalog, "_indexes", {})
    assert catalog.QUERIES[name](spark, data).count() > 0
