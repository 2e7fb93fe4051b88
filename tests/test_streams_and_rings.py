"""Streams in several batches, their state and replays; rings against a walk round each mask."""

import random
from datetime import datetime, timedelta

import pytest
from facetlake.operators import instances as I
from facetlake.operators import runs as R
from facetlake.streaming import logs
from pyspark.sql import functions as F

LOG = "run long, key string, value double, ts timestamp, event_id long"
DAY = datetime(2024, 1, 1)


class Steps:
    """A stream that reads what was written since its last run."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.rows, self.n = [], 0

    def __call__(self, rows, plan, keep=None):
        """Writes ``rows`` (minutes instead of times), runs the plan over them and gives what came out in this step."""
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        found = []
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in")
        with logs.with_state_store(self.spark):
            self.query = plan(stream).writeStream.outputMode("append").foreachBatch(keep or (lambda b, _: found.extend(map(tuple, b.collect())))).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
            self.query.awaitTermination()
        return sorted(found, key=repr)


def log_row(minute, run, key="step", event=0, value=1.0):
    return (run, key, value, DAY + timedelta(minutes=minute), event)


def minutes(micros):
    return None if micros is None else round((micros - int(DAY.timestamp() * 1e6)) / 6e7)


@pytest.fixture
def utc(spark, monkeypatch):
    import time

    monkeypatch.setenv("TZ", "UTC")
    time.tzset()
    return spark


def test_windows_close_once_state_falls_and_late_rows_are_counted(utc, tmp_path):
    step = Steps(utc, str(tmp_path), LOG)
    plan = lambda s: logs.log_metrics(s, "1 hour")
    assert step([log_row(m, r, event=m) for m in range(0, 60, 5) for r in (1, 2, 3)], plan) == []
    assert logs.late_records(step.query) == {"arrived": 36, "counted": 0, "dropped": 0, "state": 3}
    closed = step([log_row(200, 1)], plan)
    assert [(x[1], x[3]) for x in closed] == [(1, 12), (2, 12), (3, 12)]
    now = logs.late_records(step.query)
    assert (now["counted"], now["state"], now["dropped"]) == (36, 1, 0)
    assert step([log_row(10, 1), log_row(201, 1)], plan) == []  # minute 10 lies in a window that is closed
    now = logs.late_records(step.query)
    assert (now["arrived"], now["dropped"], now["state"]) == (2, 1, 1)


def test_a_hanging_run_is_told_before_its_next_record(utc, tmp_path):
    step = Steps(utc, str(tmp_path), LOG)
    plan = lambda s: logs.stall_alerts(s, 3600)
    told = lambda rows: [(r, minutes(a), minutes(b)) for r, a, b in rows]
    assert told(step([log_row(0, 1), log_row(50, 1), log_row(0, 2)], plan)) == []
    assert told(step([log_row(100, 2), log_row(55, 1)], plan)) == [(2, 0, 100)]  # told by the record that ends it
    assert told(step([log_row(130, 2)], plan)) == [(1, 55, None)]  # told by the watermark, run 1 still hangs
    assert sum(s.numRowsTotal for s in step.query.recentProgress[-1].stateOperators) <= 3  # run 1's number is gone
    assert told(step([log_row(135, 1), log_row(140, 2)], plan)) == []  # its pause is not told again
    assert told(step([log_row(300, 3)], plan)) == [(1, 135, None), (2, 140, None)]


def test_a_streak_over_two_batches_and_its_end(utc, tmp_path):
    step = Steps(utc, str(tmp_path), LOG)
    plan = lambda s: logs.zero_streaks(s, 3, "zero", keep_seconds=7200)
    assert step([log_row(2, 1, "zero", 12), log_row(1, 1, "ok", 11), log_row(3, 1, "zero", 13), log_row(1, 2, "zero", 21)], plan) == []
    assert step([log_row(4, 1, "zero", 14), log_row(5, 1, "zero", 15), log_row(2, 2, "ok", 22)], plan) == [(1, 12, 3)]
    assert step([log_row(6, 1, "zero", 16), log_row(7, 1, "ok", 17)], plan) == []
    assert step([log_row(8, 2, "zero", 23), log_row(9, 2, "zero", 24)], plan) == []
    assert step([log_row(300, 3, "ok", 31)], plan) == []  # two hours on, states of runs 1 and 2 are dropped
    assert step([log_row(301, 2, "zero", 25), log_row(302, 2, "zero", 26)], plan) == []
    assert step([log_row(303, 2, "zero", 27)], plan) == [(2, 25, 3)]


RUNS = "scene long, label long, inst long, score double, y int, x0 int, x1 int"


def box(scene, inst, x, score=1.0):
    return [(scene, 0, inst, score, y, x, x + 10) for y in range(10)]


def test_scenes_merge_as_they_grow_and_a_replay_changes_nothing(utc, tmp_path):
    keep = logs.scene_merger(str(tmp_path / "scenes"), "scene", ["scene", "label"], method="score", threshold=0.5)
    batches = [box(1, 1, 0, 0.5) + box(2, 2, 0), box(1, 3, 1, 0.9) + box(3, 4, 40), box(2, 5, 60)]
    frames = [utc.createDataFrame(b, RUNS) for b in batches]
    folder = tmp_path / "scenes" / "merged"
    written = {}
    for n, f in enumerate(frames):
        keep(f, n)
        now = {p.name: sorted(x.name for x in p.glob("*.parquet")) for p in folder.glob("scene=*")}
        touched = {f"scene={r[0]}" for r in batches[n]}
        assert {k for k in now if now[k] != written.get(k)} == touched  # no other scene's files change
        written = now

    def state():
        return sorted(map(tuple, utc.read.parquet(str(folder)).select(*[F.col(c).cast("long") for c in ("scene", "label", "cluster", "members", "y", "x0", "x1")]).collect()))

    want = I.merge_instances(utc.createDataFrame([r for b in batches for r in b], RUNS), ["scene", "label"], "score", 0.5)
    want = sorted(map(tuple, want.select(*[F.col(c).cast("long") for c in ("scene", "label", "cluster", "members", "y", "x0", "x1")]).collect()))
    assert state() == want and len({r[2] for r in want if r[0] == 2}) == 2
    keep(frames[2], 2)
    assert state() == want
    keep(frames[1], 1)  # an older batch again, as after a restore: scenes 1 and 3 are as of then
    assert state() == want


def test_a_changed_threshold_holds_from_the_next_batch_on(utc, tmp_path):
    limits, out = str(tmp_path / "limits"), str(tmp_path / "out")
    keep = logs.gate_writer(limits, out)
    rows = utc.createDataFrame([(1, {"a": 5.0}), (2, {"a": 1.0, "b": 9.0}), (3, None)], "id long, metrics map<string,double>")
    status = lambda n: {r.id: r.status for r in utc.read.parquet(f"{out}/batch={n}").collect()}
    keep(rows, 0)
    assert set(status(0).values()) == {"promoted"}
    utc.createDataFrame([("a", 2.0)], "metric string, least double").write.parquet(limits)
    keep(rows, 1)
    assert status(1) == {1: "promoted", 2: "rejected", 3: "rejected"}
    utc.createDataFrame([("a", 0.5), ("b", 1.0)], "metric string, least double").write.mode("overwrite").parquet(limits)
    keep(rows, 2)
    assert status(2) == {1: "rejected", 2: "promoted", 3: "rejected"}


def walk(edges):
    """Rings of one mask by going from edge to edge."""
    follow = {}
    for x1, y1, x2, y2 in edges:
        follow.setdefault((x1, y1), []).append((x2, y2))
    found = []
    for start in sorted(follow, key=lambda p: (p[1], p[0])):
        while follow[start]:
            ring, at = [start], follow[start].pop(0)
            while at != start:
                ways, (px, py) = follow[at], ring[-1]
                best = max(range(len(ways)), key=lambda i: (at[0] - px) * (ways[i][1] - at[1]) - (at[1] - py) * (ways[i][0] - at[0]))
                ring.append(at)
                at = ways.pop(best)
            n = len(ring)
            turns = [p for i, p in enumerate(ring) if (p[0] - ring[i - 1][0]) * (ring[(i + 1) % n][1] - p[1]) != (p[1] - ring[i - 1][1]) * (ring[(i + 1) % n][0] - p[0])]
            first = min(range(len(turns)), key=lambda i: (turns[i][1], turns[i][0]))
            found.append(turns[first:] + turns[:first])
    return sorted(([tuple(map(float, p)) for p in r] for r in found), key=lambda r: (r[0][1], r[0][0]))


def spiral(n):
    cells, x, y, dx, dy = set(), 0, 0, 1, 0
    for length in range(n, 2, -2):
        for _ in range(2):
            for _ in range(length):
                cells.add((x, y))
                x, y = x + dx, y + dy
            dx, dy = -dy, dx
    return cells


def test_rings_of_noise_spirals_and_touching_corners(spark):
    rnd = random.Random(2)
    masks = {m: {(x, y) for x in range(n) for y in range(n) if rnd.random() < p} for m, (n, p) in enumerate([(3, 0.5), (6, 0.3), (8, 0.5), (12, 0.7), (14, 0.5), (9, 0.6)])}
    masks[50] = spiral(40)
    masks[51] = {(0, 1), (1, 0), (2, 1), (1, 2)}  # a hole that only corners enclose
    masks[52] = {(0, 0), (1, 1), (5, 5)}
    runs = R.merge_runs(spark.createDataFrame([(m, y, x, x + 1) for m, cells in masks.items() for x, y in cells], "m long, y int, x0 int, x1 int"), ["m"])
    edges = R.outline(runs, ["m"])
    by, got = {}, {}
    for e in edges.collect():
        by.setdefault(e.m, []).append((e.x1, e.y1, e.x2, e.y2))
    for r in R.rings(edges, ["m"]).collect():
        got.setdefault(r.m, {}).setdefault(r.ring, {})[r.ord] = (r.x, r.y)
    assert {m: [[rings[k][i] for i in range(len(rings[k]))] for k in range(len(rings))] for m, rings in got.items()} == {m: walk(e) for m, e in by.items()}
    assert R.rings(edges.limit(0), ["m"]).count() == 0
