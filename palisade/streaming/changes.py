"""Change detection over a stream of snapshots, the audit log as a stream, and windowed counts."""

from __future__ import annotations

import heapq
import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions.rows import shared_folder, written_copy

CHANGES = "target string, before long, after long, added long, removed long"
CHANGE_COLUMNS = ["target", "before", "after", "added", "removed"]
PACKED = "target string, scan_ids array<long>, sizes array<int>, names array<string>"


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Snapshots that one row brings to the stateful step at most, and what a task holds of a target in memory, in snapshots and names.
RUN, HELD = 64, 100_000


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Snapshots of a target that come in one batch, by scan_id, as rows of up to ``RUN`` of them: their ids, how many names each has, all names."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]).sort_by([("target", "ascending"), ("scan_id", "ascending")]).combine_chunks().to_batches()[0]
        target, tools = rows.column("target"), rows.column("tools")
        code = target.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        place = np.arange(len(code))
        first = np.maximum.accumulate(np.where(np.append(True, code[1:] != code[:-1]), place, 0))
        starts = np.flatnonzero((place - first) % RUN == 0)
        sizes = tools.value_lengths().to_numpy(zero_copy_only=False).astype("int32")
        at, name = np.append(starts, len(code)).astype("int32"), np.append(0, sizes.cumsum())
        lists = [pa.ListArray.from_arrays(o, v) for o, v in ((at, rows.column("scan_id")), (at, pa.array(sizes)), (name[at].astype("int32"), tools.flatten()))]
        yield pa.RecordBatch.from_arrays([target.take(pa.array(starts)), *lists], ["target", "scan_ids", "sizes", "names"])


def _sorted(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Snapshots as ids, sizes and names, of all parts, by scan_id."""
    ids, sizes, names = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(ids, kind="stable")
    starts, sizes = (sizes.cumsum() - sizes)[order], sizes[order]
    return ids[order], sizes, names[np.repeat(starts - (sizes.cumsum() - sizes), sizes) + np.arange(len(names))]


def _changed(target: str, ids: np.ndarray, sizes: np.ndarray, names: np.ndarray) -> pd.DataFrame:
    """What snapshots in order add to the one before and leave out of it, where that is something."""
    code, kinds = pd.factorize(names, use_na_sentinel=False)
    width, n = max(len(kinds), 1), len(ids)
    held = np.unique(np.repeat(np.arange(n), sizes) * width + code)
    at = held // width
    both = np.bincount(at[held[np.searchsorted(held, held - width)] == held - width], minlength=n)[1:]
    size = np.bincount(at, minlength=n)
    found = np.stack([ids[:-1], ids[1:], size[1:] - both, size[:-1] - both], 1)
    found = pd.DataFrame(found[(found[:, 2] > 0) | (found[:, 3] > 0)], columns=CHANGE_COLUMNS[1:])
    found.insert(0, "target", target)
    return found


class _Watcher(StatefulProcessor):
    """Keyed state of ``watch``: the last snapshot of a target, and the snapshots of a batch that are too many to be held."""

    def __init__(self, forget_ms: int | None, silent_ms: int | None, held: int):
        self.forget_ms, self.silent_ms, self.held = forget_ms, silent_ms, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "scan_id long, tools array<string>", self.forget_ms)
        self.runs = handle.getMapState("runs", "scan_id long, n long", "scan_ids array<long>, sizes array<int>, names array<string>")

    def _put(self, parts: list[tuple], n: int) -> int:
        """Let the snapshots wait in the state store, in sorted runs numbered from n; the next number."""
        ids, sizes, names = _sorted(parts)
        ends = np.append(0, sizes.cumsum())
        for at in range(0, len(ids), RUN):
            to = min(at + RUN, len(ids))
            self.runs.updateValue((int(ids[at]), n), (ids[at:to].tolist(), sizes[at:to].tolist(), names[ends[at] : ends[to]].tolist()))
            n += 1
        return n

    def _run(self, key: tuple[int, int]) -> Iterator[tuple[int, int, list[str]]]:
        ids, sizes, names = self.runs.getValue(key)
        end = 0
        for scan_id, size in zip(ids, sizes, strict=True):
            yield scan_id, size, names[end : end + size]
            end += size

    def _merged(self) -> Iterator[tuple[int, int, list[str]]]:
        """The snapshots of all runs by scan_id; a run is read when its first is due."""
        due = []
        for key in [*sorted((k[0], k[1]) for k in self.runs.keys()), None]:
            while due and (key is None or due[0][0][0] < key[0]):
                snapshot, number, rest = due[0]
                yield snapshot
                following = next(rest, None)
                heapq.heappop(due) if following is None else heapq.heapreplace(due, (following, number, rest))
            if key is not None:
                rest = self._run(key)
                heapq.heappush(due, (next(rest), key[1], rest))
        self.runs.clear()

    def _in_order(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Snapshots by scan_id, in blocks. Few are sorted where they are; of more, sorted runs wait in the state store."""
        kept, size, n = [], 0, 0
        for frame in rows:
            for part in zip(frame["scan_ids"], frame["sizes"], frame["names"], strict=True):
                kept.append(part)
                size += len(part[0]) + len(part[2])
                if size >= self.held:
                    n, kept, size = self._put(kept, n), [], 0
        if kept and not n:
            yield _sorted(kept)
        elif n:
            if kept:
                self._put(kept, n)
            merged = self._merged()
            while block := list(itertools.islice(merged, 4096)):
                ids, sizes, names = zip(*block, strict=True)
                yield np.array(ids), np.array(sizes), np.array([x for some in names for x in some], dtype=object)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get() if self.last.exists() else None
        before, known = (last[0], list(last[1])) if last else (None, [])
        for ids, sizes, names in self._in_order(iter(rows)):
            new = np.append(True, ids[1:] > ids[:-1])
            if before is not None:
                new &= ids > before
            if not new.all():
                ids, sizes, names = ids[new], sizes[new], names[np.repeat(new, sizes)]
            if not len(ids):
                continue
            if before is not None:
                ids, sizes, names = np.append(before, ids), np.append(len(known), sizes), np.concatenate([np.array(known, dtype=object), names])
            found = _changed(key[0], ids, sizes, names)
            before, known = int(ids[-1]), names[len(names) - sizes[-1] :].tolist()
            if len(found):
                yield found
        if before is not None:
            self.last.update((before, sorted(set(known))))
        if self.silent_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        yield pd.DataFrame([(key[0], last, None, 0, 0)], columns=CHANGE_COLUMNS).astype({"before": "Int64", "after": "Int64"})

    def close(self) -> None:
        pass


def watch(snapshots: DataFrame, forget_ms: int | None = None, silent_ms: int | None = None) -> DataFrame:
    """Changes between consecutive snapshots of each target, as a stream: target, before, after, added, removed.

    ``snapshots`` (target, scan_id, tools: array of names) is a stream with one row per snapshot. The last snapshot of a
    target is its state, kept in the checkpoint of the query; the rows of one batch are taken in the order of scan_id, without
    holding a target's rows. Snapshots that lie together reach the stateful step as one row; their order in the source is free. A snapshot whose scan_id is not above the last one's changes nothing. With ``forget_ms`` a target is
    forgotten that long after its last snapshot; with ``silent_ms`` one that sent none for so long gives a row whose ``after`` is null. Either
    makes batches run by the clock, so such a stream ends only when it is stopped. Uses the RocksDB state store.
    """
    snapshots.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    tools = F.coalesce(F.col("tools").cast("array<string>"), F.array().cast("array<string>"))
    rows = snapshots.where("scan_id is not null").select(F.col("target").cast("string"), F.col("scan_id").cast("long"), tools.alias("tools"))
    clock = "None" if forget_ms is None and silent_ms is None else "ProcessingTime"
    packed = rows.mapInArrow(_packed, PACKED)
    return packed.groupBy("target").transformWithStateInPandas(_Watcher(forget_ms, silent_ms, HELD), CHANGES, "append", clock)


def watch_batches(snapshots: DataFrame, on_change: Callable[[DataFrame], None], checkpoint: str, interval: str = "60 seconds") -> StreamingQuery:
    """Run ``watch`` with a processing-time trigger and hand each batch of changes on; commands are never run."""
    changes = watch(snapshots)
    start = changes.writeStream.foreachBatch(lambda df, _: on_change(df)).option("checkpointLocation", checkpoint)
    return start.trigger(processingTime=interval).start()


def append_audit(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of audit events to the audit table, once each, by batch and day.

    A batch that is run again replaces itself. The table is a plain one, without a list of files of its own, so that events can be deleted.
    """

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("day", F.to_date("timestamp")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={n}")

    return events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delete_events(spark: SparkSession, path: str, gone: DataFrame | None = None, before=None) -> None:
    """Remove audit events whose id is in ``gone`` (column id), or older than ``before``, from the table of ``append_audit``.

    Only the days of batches that hold such events are rewritten. No stream may append meanwhile.
    """
    rows = spark.read.parquet(path)
    parts = [c for c in ("batch", "day") if c in rows.columns]
    old = F.lit(False) if before is None else F.coalesce(F.col("timestamp") < F.lit(before).cast("timestamp"), F.lit(False))
    hit, kept = rows.where(old).select(*parts), rows.where(~old)
    if gone is not None:
        hit = hit.unionByName(rows.join(gone.select("id"), "id", "left_semi").select(*parts))
        kept = kept.join(gone.select("id"), "id", "left_anti")
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in parts]  # noqa: E731 - the day of an event without a time is null
    places = hit.distinct()
    # A place that loses all its events keeps an empty file, so that the overwrite reaches it.
    left = kept.select(*parts).distinct()
    emptied = [r.asDict() for r in places.join(left, same(places, left), "left_anti").collect()]  # batches and days, not events
    staying = written_copy(kept.join(places, same(kept, places), "left_semi").select(*rows.columns))
    staying.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    for place in emptied:
        folder = "/".join(f"{c}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for c, v in place.items())
        spark.createDataFrame([], rows.drop(*parts).schema).write.mode("overwrite").parquet(f"{path}/{folder}")


def daily_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by day and type; works on a stream too, where days close ``late`` after their end."""
    if events.isStreaming:
        events = events.withWatermark("timestamp", late)
    days = events.groupBy(F.window("timestamp", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return days.select(F.to_date("w.start").alias("day"), "event_type", "n")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a stream gives for what its source holds now, written to the shared folder and read again."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        # Written under the number of the batch: a batch that is tried again replaces itself.
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode)
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/*")
