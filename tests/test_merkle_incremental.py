import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators import incremental as I
from spanforge.operators import merkle as M

ROW = "file_path string, hash string, other string"


def state(spark, rows):
    return spark.createDataFrame([(k, h, "x") for k, h in rows], ROW)


def test_changed_rows_against_brute_force(spark):
    rnd = random.Random(1)
    old = {f"f{i}": rnd.choice(["a", "b", None, "c"]) for i in range(300)}
    new = {k: (v if rnd.random() < 0.9 else "zz") for k, v in old.items() if rnd.random() < 0.95} | {f"g{i}": "n" for i in range(10)} | {"h": None}
    want = {k for k, v in new.items() if k not in old or v is None or old[k] is None or old[k] != v}
    got = M.changed_rows(state(spark, old.items()), state(spark, [*new.items(), (None, "a")]), "file_path", "hash")
    assert {r.file_path for r in got.collect()} == want and got.columns == ["file_path", "hash", "other"]


def test_descent_opens_only_changed_leaves(spark):
    rows = [(f"f{i}", str(i)) for i in range(500)]
    a = M.leaf_digests(state(spark, rows), "file_path", "hash")
    b = M.leaf_digests(state(spark, rows[::-1][:-1] + [("f0", "new")]), "file_path", "hash")
    want = spark.range(1).select(M.leaf_of(F.lit("f0"))).head()[0]
    assert [r.leaf for r in M.changed_leaves(a, b).collect()] == [want]
    assert M.changed_leaves(a, a).count() == 0
    empty = a.limit(0)
    assert M.changed_leaves(empty, a).count() == a.count() and M.changed_leaves(empty, empty).count() == 0


def test_pending_files(spark):
    t = lambda *d: [f"2025-01-{x:02d}" for x in d]
    scans = [
        ("same", 1, "AB", True, *t(1)), ("case", 2, " ab ", True, *t(1)), ("new", 3, "aa", True, *t(1)), ("new", 4, "bb", True, *t(2)), ("new", 4, "bb", True, *t(2)),
        ("gone", 5, "x", True, *t(1)), ("gone", 6, "x", False, *t(2)), ("changed", 7, "c2", True, *t(3)), ("nohash", 8, "c", True, *t(1)), ("null", 9, None, True, *t(1)),
        ("failed", 10, "f", True, *t(1)), ("tie", 11, "t1", True, *t(1)), ("tie", 12, "t2", True, *t(1)), (None, 13, "x", True, *t(1)), ("unsure", 14, "u", None, *t(1)),
    ]
    registry = [("same", "ab", 1), ("case", "AB", 1), ("gone", "x", 1), ("changed", "c2", 1), ("changed", "c1", 3), ("changed", "c2", 2), ("nohash", "", 1), ("null", "n", 1), ("failed", "f", 2), ("tie", "t2", 1)]
    runs = [(1, "2025-01-01", "success"), (2, "2025-01-05", "failed"), (3, "2025-01-03", "success"), (4, "2025-01-09", None)]
    s = spark.createDataFrame(scans, "file_path string, scan_id long, hash string, present boolean, t string").selectExpr("*", "cast(t as timestamp) seen_at")
    r = spark.createDataFrame(registry, "file_path string, hash string, run_id long").selectExpr("*", "timestamp'2025-01-01' written_at", "'x' present")
    u = spark.createDataFrame(runs, "run_id long, t string, status string").selectExpr("run_id", "cast(t as timestamp) started_at", "status", "'h' hash")
    got = {(x.file_path, x.scan_id) for x in M.pending_files(s, r, u).collect()}
    assert got == {("new", 4), ("changed", 7), ("nohash", 8), ("null", 9), ("failed", 10)}
    assert M.pending_files(s.limit(0), r, u).count() == 0
    assert M.pending_files(s, r.limit(0), u).count() == 8


def test_store_survives_a_failed_run(spark, tmp_path):
    store = M.MerkleStore(spark, f"file://{tmp_path}/m")
    one = state(spark, [("a", "1"), ("b", "2"), (None, "3")])
    assert store.changes(one).count() == 2
    store.publish(one, one.select("file_path"))
    two = state(spark, [("a", "1"), ("b", "9"), ("c", "3")])
    assert {r.file_path for r in store.changes(two).collect()} == {"b", "c"}
    broken = two.withColumn("x", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        store.publish(two, broken)
    assert {r.file_path for r in store.changes(two).collect()} == {"b", "c"}  # nothing skipped
    store.publish(two, store.changes(two))
    assert store.changes(two).count() == 0  # nothing repeated


def test_scan_changes(spark):
    f = spark.createDataFrame([("same", 1.0, "a"), ("touched", 2.0, "A"), ("mod", 2.0, "b"), ("add", 1.0, "c"), (None, 1.0, "c"), ("nul", 2.0, None)], "file_path string, mtime double, hash string")
    r = spark.createDataFrame([("same", 1.0, "zz", 1), ("touched", 1.0, "a", 2), ("mod", 1.0, "a", 3), ("del", 1.0, "d", 4), ("nul", 1.0, None, 1)], "file_path string, mtime double, hash string, chunks int")
    c = I.scan_changes(f, r)
    names = lambda df: sorted(x.file_path for x in df.collect())
    assert (names(c.added), names(c.modified), names(c.deleted), names(c.touched)) == (["add"], ["mod", "nul"], ["del"], ["touched"])
    assert {x.change: x.files for x in I.change_counts(c).collect()} == {"added": 1, "modified": 2, "deleted": 1}
