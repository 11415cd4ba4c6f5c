"""The published tree is what the next run is compared with."""

import shutil

import numpy as np
import pytest

from spanforge.operators import merkle as M


def test_changes_reads_the_saved_tree(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, "file_path string, hash string")
    store = M.MerkleStore(spark, f"file://{tmp_path}/s")
    first, new = make(("a", "1"), ("b", "2"), ("n", None)), make(("a", "1"), ("b", "3"), ("c", "4"), ("n", None))
    version = store.publish(first, first)
    assert {r.file_path for r in store.changes(new).collect()} == {"b", "c", "n"}
    at = f"{tmp_path}/s/v={version}/tree"
    shutil.rmtree(at)
    M.saved_tree(new.where("hash is not null"), "file_path", "hash").write.parquet(f"file://{at}")
    assert {r.file_path for r in store.changes(new).collect()} == {"n"}  # only a saved tree can say that


def test_a_crash_at_any_step_of_publish_changes_nothing(spark, tmp_path, monkeypatch):
    make = lambda *rows: spark.createDataFrame(rows, "file_path string, hash string")
    store = M.MerkleStore(spark, f"file://{tmp_path}/s")
    store.publish(make(("a", "1"), ("b", "2")), make(("a", "1"), ("b", "2")))
    new = make(("a", "1"), ("b", "3"), ("c", "4"))
    before = store.current()
    steps = ["tree", "pointer", "move"]
    for step in steps:
        with monkeypatch.context() as m:
            fail = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("crash"))
            if step == "tree":
                m.setattr(M, "saved_tree", fail)
            elif step == "pointer":
                m.setattr(M.Pointer, "write", fail)
            else:  # between writing the pointer file and moving it into place
                fs = store.pointer._fs
                m.setattr(store.pointer, "_fs", type("Fs", (), {"rename": fail, "__getattr__": lambda self, name: getattr(fs, name)})())
            with pytest.raises(RuntimeError, match="crash"):
                store.publish(new, store.changes(new))
        assert store.current() == before
        assert {r.file_path for r in M.MerkleStore(spark, store.root).changes(new).collect()} == {"b", "c"}
    store.publish(new, store.changes(new))
    assert store.current() != before and store.changes(new).count() == 0


def test_depth_follows_the_rows():
    assert [M.depth_for(n) for n in (0, 4_096, 4_097, 10**6, 10**8, 10**12)] == [1, 1, 2, 3, 5, 5]


def test_descent_in_one_array():
    rng = np.random.default_rng(1)
    old = rng.integers(1, 1 << 60, 16**3).astype(np.uint64)
    new = old.copy()
    new[[5, 77, 4000]] = [0, 1, 2]
    assert M.descend(old, new, 16, 3).tolist() == [5, 77, 4000] and not len(M.descend(old, old, 16, 3))
    swapped = old.copy()
    swapped[[8, 9]] = old[[9, 8]]
    assert M.descend(old, swapped, 16, 3).tolist() == [8, 9]


def test_tasks_follow_the_files_and_not_unknown_sizes(spark, tmp_path):
    from spanforge.runtime import tasks_for

    rows = spark.range(20_000).selectExpr("id", "uuid() u")
    rows.write.parquet(f"file://{tmp_path}/t")
    read = spark.read.parquet(f"file://{tmp_path}/t")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(read) == least < 20 < tasks_for(read, 10_000) < 1000
    assert tasks_for(spark.createDataFrame([(1,)], "id long")) == least == tasks_for(spark.createDataFrame(rows.limit(3).rdd, rows.schema))
    assert tasks_for(read.join(read.withColumnRenamed("u", "v"), "id"), 10_000) <= 2 * tasks_for(read, 10_000)
