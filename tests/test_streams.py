"""Keyed state of the change stream: order, restarts, many runs of rows, silence."""

import random
import time

from palisade.streaming import changes

KIND = "target string, scan_id long, tools array<string>"


def plain_changes(rows):
    found, last = [], {}
    for target, scan_id, tools in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0], r[1])):
        now = set(tools or ())
        if target in last:
            before, known = last[target]
            if now != known:
                found.append((target, before, scan_id, len(now - known), len(known - now)))
        last[target] = scan_id, now
    return sorted(found)


def run(spark, source, check, seen):
    stream = changes.watch(spark.readStream.schema(KIND).parquet(source))
    query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", check)
    query.trigger(availableNow=True).start().awaitTermination(120)


def test_batches_and_runs_keep_the_order(spark, tmp_path):
    """Two batches of one target, each of more runs than one, over a restart between them."""
    rnd = random.Random(2)
    rows = [("t", i, rnd.sample("abcdef", rnd.randint(0, 5))) for i in range(60)] + [("u", i, ["x"] if i < 5 else None) for i in range(9)]
    halves = [[r for r in rows if r[1] < 25], [r for r in rows if r[1] >= 25]]
    source, check, seen = str(tmp_path / "in"), str(tmp_path / "check"), []
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        for half in halves:
            rnd.shuffle(half)
            extra = [("t", None, ["z"])] + ([("t", 3, ["late"])] if half is halves[1] else [])
            spark.createDataFrame(half + extra, KIND).coalesce(1).write.mode("append").parquet(source)
            run(spark, source, check, seen)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert sorted(seen) == plain_changes(rows)


def test_many_snapshots_reach_the_state_in_runs(spark, tmp_path, monkeypatch):
    """A target of many Arrow batches: what can be held never goes to the state store, more goes there run by run."""
    rnd = random.Random(4)
    rows = [("t", i, rnd.sample("abcdef", rnd.randint(0, 5)) + ["a"] * rnd.randint(0, 1)) for i in range(2000)] + [(None, i, [str(i // 2)]) for i in range(9)]
    found = [(t, b, i, 1, 1) for t, b, i in ((None, i, i + 1) for i in range(1, 8, 2))]
    rnd.shuffle(rows)
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(tmp_path / "in"))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        for most, puts in ((None, 20), (500, 400)):
            if most:
                monkeypatch.setattr(changes, "HELD", most)
            seen = []
            query = changes.watch(spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))).writeStream.foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect()))  # noqa: B023
            query = query.option("checkpointLocation", str(tmp_path / f"check-{puts}")).trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert sorted(r for r in seen if r[0]) == plain_changes(r for r in rows if r[0]) and sorted(r for r in seen if not r[0]) == found
            assert 0 < sum(int(o["customMetrics"]["rocksdbPutCount"]) for p in query.recentProgress for o in p["stateOperators"]) < puts
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_snapshots_that_lie_together_are_one_row():
    import pyarrow as pa

    kind = pa.schema([("target", pa.string()), ("scan_id", pa.int64()), ("tools", pa.list_(pa.string()))])
    rows = [("b", i, ["x"] * (i % 3)) for i in range(150, 0, -1)] + [("a", 7, []), (None, 1, ["n", None]), ("b", 200, ["y"])]
    batch = pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], schema=kind)
    packed = [r for b in changes._packed(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert sorted((r["target"] or "", len(r["scan_ids"])) for r in packed) == [("", 1), ("a", 1), ("b", 23), ("b", 64), ("b", 64)]
    back = []
    for r in packed:
        names = iter(r["names"])
        back += [(r["target"], i, [next(names) for _ in range(n)]) for i, n in zip(r["scan_ids"], r["sizes"], strict=True)]
        assert not list(names)
    order = lambda r: (r[0] or "", r[1])
    assert sorted(back, key=order) == sorted(rows, key=order)


def test_silent_targets_are_told(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    spark.createDataFrame([("t", 1, ["a"]), ("t", 2, ["b"])], KIND).write.parquet(source)
    stream = changes.watch(spark.readStream.schema(KIND).parquet(source), forget_ms=3_600_000, silent_ms=500)
    query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "check"))
    query = query.trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and len(seen) < 2 and query.isActive:
            time.sleep(0.5)
    finally:
        query.stop()
    assert seen[:2] == [("t", 1, 2, 1, 1), ("t", 2, None, 0, 0)]
