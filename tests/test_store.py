"""The snapshot store: commits over all tables, failures between them, versions, fingerprints."""

import pytest
from pyspark.sql import functions as F

from palisade.sources import store

SCANS = "scan_id long, target string, scanned_at string"
CHILD = "scan_id long, ord int, name string"


def children(spark, scans, tag, names=store.CHILDREN):
    return {n: spark.createDataFrame([(s, i, f"{n}-{s}-{i}-{tag}") for s in scans for i in (2, 1)], CHILD) for n in names}


def put(spark, root, scans, tag, **options):
    rows = spark.createDataFrame([(s, f"t{s}", f"2024-01-0{s % 9 + 1}") for s in scans], SCANS)
    return store.commit(spark, root, rows, children(spark, scans, tag, **options))


def held(spark, root, name, version=None):
    return sorted((r["scan_id"], r["name"]) for r in store.read(spark, root, name, version).collect())


def rows_of(name, scans, tag):
    return sorted((s, f"{name}-{s}-{i}-{tag}") for s in scans for i in (1, 2))


def test_commits_replace_scans_with_all_children(spark, tmp_path):
    root = str(tmp_path)
    assert put(spark, root, [1, 2, 3], "a") == 1
    assert put(spark, root, [2, 4], "b") == 2
    for name in store.CHILDREN:
        assert held(spark, root, name) == sorted(rows_of(name, [1, 3], "a") + rows_of(name, [2, 4], "b"))
        assert held(spark, root, name, 1) == rows_of(name, [1, 2, 3], "a")
    # A scan that comes without prompts has none.
    put(spark, root, [4], "c", names=("tools",))
    got = store.load_scan(spark, root, 4).first()
    assert [t["name"] for t in got["tools"]] == ["tools-4-1-c", "tools-4-2-c"] and got["prompts"] is None and got["target"] == "t4"
    assert [t["name"] for t in store.load_scan(spark, root, 4, 2).first()["prompts"]] == ["prompts-4-1-b", "prompts-4-2-b"]
    assert store.delete_scans(spark, root, spark.createDataFrame([(1,), (77,), (None,)], "scan_id long")) == 4
    assert all(1 not in {s for s, _ in held(spark, root, n)} for n in store.CHILDREN)
    with pytest.raises(LookupError):
        store.load_scan(spark, root, 1)
    store.purge(spark, root, "2024-01-04")
    assert [r["scan_id"] for r in store.read(spark, root, "scans").collect()] == [3, 4] or sorted(r["scan_id"] for r in store.read(spark, root, "scans").collect()) == [3, 4]
    assert {s for s, _ in held(spark, root, "tools")} == {3, 4}


def test_a_failed_commit_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path)
    put(spark, root, [1, 2], "a")
    bad = children(spark, [1, 5], "b")
    bad["resources"] = bad["resources"].withColumn("name", F.when(F.col("scan_id") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    scans = spark.createDataFrame([(1, "t1", "2025"), (5, "t5", "2025")], SCANS)
    with pytest.raises(Exception, match="lost"):
        store.commit(spark, root, scans, bad)
    assert store.versions(spark, root) == [1]
    for name in store.CHILDREN:
        assert held(spark, root, name) == rows_of(name, [1, 2], "a")
    # What the failed commit wrote is written over by the next one.
    assert put(spark, root, [1], "c") == 2
    for name in store.CHILDREN:
        assert held(spark, root, name) == sorted(rows_of(name, [1], "c") + rows_of(name, [2], "a"))


def test_two_commits_at_once_and_bad_ones(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    put(spark, root, [1], "a")
    old = store.manifest(spark, root)
    put(spark, root, [2], "b")
    monkeypatch.setattr(store, "manifest", lambda *_: old)
    with pytest.raises(store.Conflict):
        store._publish(spark, root, {"version": 2, "tables": {}})
    monkeypatch.undo()
    assert held(spark, root, "tools") == sorted(rows_of("tools", [1], "a") + rows_of("tools", [2], "b"))
    scans = spark.createDataFrame([(3, "t", "2024")], SCANS)
    with pytest.raises(ValueError, match="without a scan"):
        store.commit(spark, root, scans, children(spark, [3, 4], "x"))
    with pytest.raises(ValueError, match="child"):
        store.commit(spark, root, scans, {"other": scans})
    with pytest.raises(ValueError, match="nothing"):
        store.commit(spark, root)
    with pytest.raises(LookupError):
        store.read(spark, str(tmp_path / "none"), "scans")


def test_fingerprints_keep_the_newest(spark, tmp_path):
    root, kind = str(tmp_path), "server_id string, endpoint string, last_seen string, tool_count int"
    put(spark, root, [1], "a")
    store.merge_fingerprints(spark, root, spark.createDataFrame([("s1", "e", "2024-03", 3), ("s2", "e", "2024-01", 1), ("s2", "e", "2024-02", 2), (None, "e", "2025", 0)], kind))
    store.merge_fingerprints(spark, root, spark.createDataFrame([("s1", "e", "2024-01", 9), ("s2", "e", "2024-04", 4), ("s3", "f", "2024-02", 5)], kind))
    assert [(r["server_id"], r["tool_count"]) for r in store.fingerprints(spark, root).collect()] == [("s2", 4), ("s1", 3), ("s3", 5)]
    assert store.delete_fingerprints(spark, root, spark.createDataFrame([("s1",), ("none",)], "server_id string")) == 1
    assert store.delete_fingerprints(spark, root, spark.createDataFrame([("none",)], "server_id string")) == 0
    assert [r["server_id"] for r in store.fingerprints(spark, root).collect()] == ["s2", "s3"]
    assert held(spark, root, "tools") == rows_of("tools", [1], "a")
