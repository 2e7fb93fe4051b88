"""Streaming operators: windowed log metrics, stall alerts, streaks, detections, scene merging and gates.

Records may be late by ``LATE``; later ones are dropped by the watermark. The stateful operators keep
numbers alone as state and drop it by event time; they need the RocksDB state store, which
``with_state_store`` sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.utils import AnalysisException

from facetlake.operators.instances import merge_instances
from facetlake.operators.runs import TASK_RUNS

LATE = "10 minutes"
#: Scenes of a batch that every executor may hold.
FEW_SCENES = 1 << 16
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def log_metrics(log: DataFrame, window: str = "1 hour", late: str = LATE) -> DataFrame:
    """Number, mean and latest value of each run and key in each time window.

    For append mode: a window comes out once, when the watermark passes its end, and its state goes
    with it, so state holds the windows of the last hours however long the stream runs. What arrived and
    what came out in windows is observed as ``arrived`` and ``counted``; see ``late_records``.
    """
    log = log.observe("arrived", F.count(F.lit(1)).alias("n"))
    w = log.withWatermark("ts", late).groupBy(F.window("ts", window), "run", "key")
    x = w.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"))
    return x.select(F.col("window.start").alias("start"), "run", "key", "n", "mean", "latest").observe("counted", F.sum("n").alias("n"))


def late_records(query: StreamingQuery) -> dict[str, int]:
    """Sums over a query's recent progress: rows that ``arrived`` and are ``counted`` in closed windows, groups of rows ``dropped`` as too late, and the ``state`` rows held now.

    A task drops late rows after adding them up by window and key, so ``dropped`` is at least one for
    each window, run and key that had any.
    """
    progress = query.recentProgress
    of = lambda p, name: (p.observedMetrics or {}).get(name)
    total = lambda name: sum((of(p, name)["n"] or 0) for p in progress if of(p, name) is not None)
    last = [sum(s.numRowsTotal for s in p.stateOperators) for p in progress]
    return {"arrived": total("arrived"), "counted": total("counted"), "dropped": sum(s.numRowsDroppedByWatermark for p in progress for s in p.stateOperators), "state": last[-1] if last else 0}


def _millis(micros: int) -> int:
    return -(-int(micros) // 1000)


class StallAlerts(StatefulProcessor):
    """Watches when each run was last seen; state is that one number."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seen = [np.sort(frame[["low", "high"]].to_numpy(np.int64).ravel()) for frame in rows]
        known = int(self.last.get()[0]) if self.last.exists() else None
        at = np.sort(np.concatenate(seen))
        at = at if known is None else np.concatenate(([known], at[at > known]))
        quiet = np.flatnonzero(np.diff(at) > self.gap)
        if known is not None:
            self.handle.deleteTimer(_millis(known + self.gap))
        self.last.update((int(at[-1]),))
        self.handle.registerTimer(_millis(at[-1] + self.gap))
        yield self._alerts(key, at[quiet], at[quiet + 1])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last = int(self.last.get()[0])
        self.last.clear()
        yield self._alerts(key, [last], [None])

    def close(self) -> None:
        pass

    @staticmethod
    def _alerts(key: Any, since: Any, until: Any) -> pd.DataFrame:
        return pd.DataFrame({"run": pd.array([key[0]] * len(since), "int64"), "since": pd.array(list(since), "int64"), "until": pd.array(list(until), "Int64")})


STALL = "run long, since long, until long"


def stall_alerts(log: DataFrame, gap_seconds: float = 7200, late: str = LATE) -> DataFrame:
    """``(run, since, until)``: one alert for each pause of a run longer than ``gap_seconds``; ``until`` is null while the run still hangs.

    A timer at the last record plus the gap goes off when the watermark passes it, so a run that hangs
    is told before its next record comes; with it the run's state goes. A pause that ends before that, as
    in a backlog, is told from the record that ends it. Before the shuffle each task cuts its records to
    the first and last one of every stretch as long as half the gap, in which no pause can lie, so a
    hot run is a few rows a task.
    """
    gap = int(gap_seconds * 1_000_000)

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = frame.groupby([frame["run"], frame["at"] // max(1, gap // 2)], sort=False)["at"].agg(["min", "max"]).reset_index()
            yield pd.DataFrame({"run": x["run"], "low": x["min"], "high": x["max"]})

    cut = log.where("run IS NOT NULL AND ts IS NOT NULL").select("run", F.unix_micros("ts").alias("at")).mapInPandas(ends, "run long, low long, high long")
    timed = cut.withColumn("ts", F.timestamp_micros("high")).withWatermark("ts", late)
    return timed.groupBy("run").transformWithStateInPandas(StallAlerts(gap), STALL, "Append", "EventTime")


class ZeroStreaks(StatefulProcessor):
    """Length and first record of each run's stretch of hits as yet; a timer drops what has had no record for ``keep``."""

    def __init__(self, least: int, keep: int):
        self.least, self.keep = least, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.stretch = handle, handle.getValueState("stretch", "first long, length long, at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, length, known = map(int, self.stretch.get()) if self.stretch.exists() else (-1, 0, None)
        parts = [(f["at"].to_numpy(np.int64), f["event_id"].to_numpy(np.int64), f["hit"].to_numpy(bool)) for f in rows]
        at, event, hit = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((event, at))
        event, hit = event[order], hit[order]
        edge = np.flatnonzero(np.diff(np.concatenate(([not hit[0]], hit)).astype(np.int8)))  # first places of stretches of equal hits
        out = []
        for a, b in zip(edge, [*edge[1:], len(hit)], strict=True):
            if not hit[a]:
                first, length = -1, 0
                continue
            before, length = length, length + int(b - a)
            first = int(event[a]) if before == 0 else first
            if before < self.least <= length:
                out.append((key[0], first, self.least))
        latest = max(int(at.max()), known or int(at.max()))
        if known is not None:
            self.handle.deleteTimer(_millis(known + self.keep))
        self.stretch.update((first, length, latest))
        self.handle.registerTimer(_millis(latest + self.keep))
        yield pd.DataFrame(out, columns=["run", "first_event", "length"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.stretch.clear()
        yield pd.DataFrame({"run": pd.array([], "int64"), "first_event": pd.array([], "int64"), "length": pd.array([], "int64")})

    def close(self) -> None:
        pass


STREAK = "run long, first_event long, length long"


def zero_streaks(log: DataFrame, least: int = 3, hit: str = "error", keep_seconds: float = 86_400 * 30, late: str = LATE) -> DataFrame:
    """One alert for each stretch of ``least`` records of key ``hit`` in a row of a run, when it gets that long.

    State is a run's stretch as yet, three numbers, and goes when the watermark is ``keep_seconds`` past
    the run's last record. A batch's records of a run are taken in the order of their time as three
    plain arrays, 17 bytes a record; how many come in a batch is the source's to bound. A stretch may
    begin in one batch and end in a later one.
    """
    x = log.where("run IS NOT NULL AND ts IS NOT NULL").select("run", "event_id", F.unix_micros("ts").alias("at"), F.coalesce(F.col("key") == hit, F.lit(False)).alias("hit"), "ts").withWatermark("ts", late)
    return x.groupBy("run").transformWithStateInPandas(ZeroStreaks(least, int(keep_seconds * 1_000_000)), STREAK, "Append", "EventTime")


def new_detections(detections: DataFrame, keys: list[str], least_score: float = 0.35) -> DataFrame:
    """Detections above a score, each once while the watermark holds its key."""
    return detections.where(F.col("score") >= least_score).withWatermark("ts", LATE).dropDuplicatesWithinWatermark(keys)


def scene_merger(path: str, scene: str, keys: list[str], **merging) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps merged instances of all scenes below ``path`` up to date.

    ``batch`` has runs of scored instances as ``merge_instances`` takes them, ``keys`` (scene among them)
    being its keys. The batch's runs go to ``path/runs/batch=N``; then the scenes that it touches, and no
    other, are merged from all runs of theirs, and their partitions of ``path/merged`` replaced. A batch
    that runs again writes its own folder again, reads what came before it and replaces the same
    partitions with the same rows, so a replay changes nothing. An instance that comes again counts once.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").partitionBy(scene).parquet(f"{path}/runs/batch={number}")
        every = spark.read.option("basePath", f"{path}/runs").parquet(*[f"{path}/runs/batch={n}" for n in _batches(spark, f"{path}/runs") if n <= number])
        every = every.select(*[F.col(f.name).cast(f.dataType) for f in batch.schema.fields], "batch")
        touched = every.where(F.col("batch") == number).select(scene).distinct()
        touched = F.broadcast(touched) if touched.count() <= FEW_SCENES else touched.hint("merge")
        own = every.join(touched, scene, "left_semi").drop("batch")
        # dealt by the number of runs: they shrink so much on their way that bytes say little of them
        own = own.repartition(max(1, -(-every.count() // TASK_RUNS)), *keys).distinct()
        merged = merge_instances(own, keys, **merging)
        merged.repartition(scene).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scene).parquet(f"{path}/merged")

    return keep


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches written below a folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def gate(records: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Each arriving record (with a map ``metrics``) with its status: promoted if no metric is below its threshold, a missing one being 0.

    ``thresholds`` is a static table ``(metric, least)`` of any metrics; it becomes one row of one map,
    which every record meets.
    """
    limits = thresholds.agg(F.map_from_entries(F.collect_list(F.struct("metric", "least"))).alias("limits"))
    value = lambda k: F.coalesce(F.try_element_at("metrics", k), F.lit(0.0))
    ok = F.forall(F.map_entries("limits"), lambda e: value(e["key"]) >= e["value"])
    return records.crossJoin(F.broadcast(limits)).withColumn("status", F.when(ok, "promoted").otherwise("rejected")).drop("limits")


def gate_writer(thresholds_path: str, out: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that gates each batch by the thresholds table as it is then, so a changed threshold holds from the next batch on."""

    def keep(batch: DataFrame, number: int) -> None:
        try:
            limits = batch.sparkSession.read.parquet(thresholds_path)
        except AnalysisException:  # no table yet: nothing to fall short of
            limits = batch.sparkSession.createDataFrame([], "metric string, least double")
        gate(batch, limits).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return keep
