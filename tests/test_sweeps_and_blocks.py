"""Overlay, votes, overlaps, components, hinge, line walk and dominant directions against plain versions."""

import math
import random

import numpy as np
import pytest
from facetlake.operators import audit as A
from facetlake.operators import evaluate as E
from facetlake.operators import geometry as G
from facetlake.operators import overlap as O
from facetlake.operators import runs as R
from facetlake.operators import views as V
from pyspark.sql import functions as F


def random_layers(n, seed, rows=3, width=60):
    rnd = random.Random(seed)
    return [(rnd.choice([1, None]), rnd.randrange(rows), a := rnd.randrange(width), a + rnd.randint(1, 25), rnd.randrange(4), rnd.randrange(8), i) for i in range(n)]


LAYER = "scene long, y int, x0 int, x1 int, cls int, z int, inst long"


def test_overlay_of_many_layers_on_few_rows(spark):
    rows = random_layers(400, 1)
    top = {}
    for scene, y, x0, x1, cls, z, i in rows:
        for x in range(x0, x1):
            top[scene, y, x] = max(top.get((scene, y, x), (-1, -1, None)), (z, i, cls))
    got = {}
    for r in R.overlay(spark.createDataFrame(rows, LAYER), ["scene"], "cls", ["z", "inst"]).collect():
        for x in range(r.x0, r.x1):
            assert (r.scene, r.y, x) not in got
            got[r.scene, r.y, x] = r.cls
    assert got == {k: v[2] for k, v in top.items()}
    assert R.overlay(spark.createDataFrame([], LAYER), ["scene"], "cls", ["inst"]).count() == 0


def test_overlay_runs_are_longest(spark):
    rows = [(1, 0, x, x + 2, 5, x, x) for x in range(0, 40)] + [(1, 0, 60, 61, 5, 1, 99), (1, 1, 0, 3, 5, 1, 98)]
    got = sorted((r.y, r.x0, r.x1) for r in R.overlay(spark.createDataFrame(rows, LAYER), ["scene"], "cls", ["inst"]).collect())
    assert got == [(0, 0, 41), (0, 60, 61), (1, 0, 3)]


def test_sweep_counts_and_weighs_what_lies_over_each_interval(spark):
    rows = [r for r in random_layers(200, 2) if r[0]]
    got = R.sweep(spark.createDataFrame(rows, LAYER).withColumn("w", F.col("z") / 10), ["scene"], "w").collect()
    for r in got:
        over = [z for _, y, x0, x1, _, z, _ in rows if y == r.y and x0 <= r.x0 and r.x1 <= x1]
        assert len(over) == r.n and float(r.w) == pytest.approx(sum(over) / 10) and over
    assert sum(r.x1 - r.x0 for r in got) == len({(y, x) for _, y, x0, x1, _, _, _ in rows for x in range(x0, x1)})


def test_overlap_of_instances_with_several_runs_a_row(spark):
    rnd = random.Random(3)
    cells = {(s, i): {(rnd.randrange(12) + 20 * (i % 2), rnd.randrange(-5, 40)) for _ in range(rnd.randint(1, 200))} for s in (1, 2) for i in range(s * 10, s * 10 + 8)}
    runs = R.merge_runs(spark.createDataFrame([(s, i, y, x, x + 1) for (s, i), c in cells.items() for y, x in c], "scene long, inst long, y int, x0 int, x1 int"), ["scene", "inst"])
    want = {(a[1], b[1]): len(cells[a] & cells[b]) for a in cells for b in cells if a[0] == b[0] and a < b and cells[a] & cells[b]}
    got = O.instance_overlap(runs, runs, ["scene"], between=F.col("a.inst") < F.col("b.inst")).collect()
    assert {(r.a, r.b): r.inter for r in got} == want
    assert all(r.union == len(cells[r.scene, r.a] | cells[r.scene, r.b]) for r in got)


@pytest.mark.parametrize("block_rows", [1, 3, 7, 128])
def test_components_over_blocks_of_any_height(spark, block_rows):
    rnd = random.Random(4)
    cells = {m: {(x, y) for y in range(-6, 20) for x in range(25) if rnd.random() < p} for m, p in ((0, 0.3), (1, 0.45), (None, 0.5))}
    cells[7] = {(x, y) for y in range(0, 20, 2) for x in range(20)} | {(19 * (y // 2 % 2), y) for y in range(1, 20, 2)}  # one snake
    want = {}
    for m, left in cells.items():
        left = set(left)
        while left:
            todo, part = [left.pop()], set()
            while todo:
                x, y = todo.pop()
                part.add((x, y))
                near = {(x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)} & left
                left -= near
                todo += near
            want.setdefault(m, set()).add(frozenset(part))
    if None in want:  # rows without a key meet no others at a block's border
        want.pop(None)
    runs = spark.createDataFrame([(m, y, x, x + 1) for m, c in cells.items() for x, y in c], "m long, y int, x0 int, x1 int")
    found = {}
    for r in R.run_components(runs, ["m"], block_rows).collect():
        if r.m is not None:
            found.setdefault((r.m, r.component), set()).update((x, r.y) for x in range(r.x0, r.x1))
    got = {}
    for (m, _), c in found.items():
        got.setdefault(m, set()).add(frozenset(c))
    assert got == want and len(got[7]) == 1
    assert R.run_components(runs.limit(0), ["m"]).count() == 0


def plain_hinge(logits, targets):
    err = 1 - logits * (2 * targets - 1)
    order = np.lexsort((np.arange(len(err)), -err))
    t = targets[order]
    seen, total = np.cumsum(t), t.sum()
    j = 1 - (total - seen) / (total + np.arange(1, len(t) + 1) - seen)
    return float(np.sum(np.maximum(err[order], 0) * np.diff(np.concatenate(([0], j)))))


def test_hinge_of_one_large_mask_is_cut_into_ranges(spark, monkeypatch):
    written, write = [], E.materialize
    monkeypatch.setattr(E, "materialize", lambda *a: written.append(write(*a)) or written[-1])
    rng = np.random.default_rng(5)
    n = 60_000
    logits, targets = np.round(rng.normal(size=n), 2), (rng.random(n) < 0.3).astype(float)
    logits[: n // 3] = 0.25  # a third of the errors are one of two values
    rows = spark.createDataFrame([(1, float(x), float(t), i) for i, (x, t) in enumerate(zip(logits, targets, strict=True))], "m long, logit double, t double, o long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert E.lovasz_hinge(rows, ["m"], "logit", "t", "o").first().loss == pytest.approx(plain_hinge(logits, targets), abs=1e-9)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in written[0].groupBy("range").count().collect()) < 0.6 * n
    none = spark.createDataFrame([(1, -2.0, 0.0, 0), (1, -3.0, 0.0, 1), (2, 0.5, 0.0, 0)], "m long, logit double, t double, o long")
    assert {r.m: round(r.loss, 9) for r in E.lovasz_hinge(none, ["m"], "logit", "t", "o").collect()} == {1: 0.0, 2: 1.5}


def test_corners_snap_to_long_slanted_lines(spark):
    rnd = random.Random(6)
    lines = [(1, i, *(rnd.uniform(0, 400) for _ in range(4))) for i in range(12)] + [(1, 20, 50.0, 0.0, 50.0, 390.0), (1, 21, 7.0, 9.0, 7.0, 9.0), (1, 22, 0.0, 77.0, 390.0, 77.0)]
    points = [(1, i, rnd.uniform(0, 400), rnd.uniform(0, 400)) for i in range(600)]

    def nearest(px, py, reach):
        best = None
        for _, seg, x1, y1, x2, y2 in lines:
            n2 = (x2 - x1) ** 2 + (y2 - y1) ** 2
            t = min(max(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / n2, 0), 1) if n2 else 0
            qx, qy = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
            d = math.hypot(px - qx, py - qy)
            if d < reach and (best is None or (d, seg) < best[:2]):
                best = d, seg, qx, qy
        return best[2:] if best else (px, py)

    v = spark.createDataFrame(points, "scene long, ord long, x double, y double")
    seg = spark.createDataFrame(lines, "scene long, seg long, x1 double, y1 double, x2 double, y2 double")
    got = {r.ord: (r.x, r.y) for r in G.snap_to_lines(v, seg, "scene", 6.0).collect()}
    want = {i: nearest(x, y, 6.0) for _, i, x, y in points}
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want) and sum(got[i] != (x, y) for _, i, x, y in points) > 50


def plain_dominant(pts):
    """Sides turned level or upright in place, twice round."""
    n = len(pts)
    sides = [(pts[(i + 1) % n][0] - pts[i][0], pts[(i + 1) % n][1] - pts[i][1]) for i in range(n)]
    length = [math.hypot(*s) for s in sides]
    mean = sum(math.atan2(dy, dx) % (math.pi / 2) * w for (dx, dy), w in zip(sides, length, strict=True)) / sum(length)
    c, s = math.cos(mean), math.sin(mean)
    p = [[x * c + y * s, y * c - x * s] for x, y in pts]
    for i in [*range(n), *range(n)]:
        before, here = p[i - 1], p[i]
        at = 1 if abs(here[0] - before[0]) > abs(here[1] - before[1]) else 0
        here[at] = before[at]
    return [(u * c - v * s, u * s + v * c) for u, v in p]


def test_dominant_direction_goes_twice_round(spark):
    rnd = random.Random(7)
    rings = {k: [(20 + 15 * math.cos(a) + rnd.uniform(-2, 2), 20 + 10 * math.sin(a) + rnd.uniform(-2, 2)) for a in (2 * math.pi * i / n for i in range(n))] for k, n in enumerate([3, 4, 4, 5, 6, 7, 8, 11])}
    rings[50] = [(0.0, 0.0), (5.0, 1.0)]
    v = spark.createDataFrame([(k, i, x, y) for k, r in rings.items() for i, (x, y) in enumerate(r)], "k long, ord long, x double, y double")
    got = {}
    for r in G.align_dominant(v, ["k"]).collect():
        got.setdefault(r.k, {})[r.ord] = (r.x, r.y)
    for k, ring in rings.items():
        want = plain_dominant(ring) if len(ring) > 2 else ring
        assert all(got[k][i] == pytest.approx(p, abs=1e-9) for i, p in enumerate(want))


def test_prompts_of_an_odd_mask(spark):
    cells = [(1, 0, 0, 3), (1, 2, 5, 6)]
    runs = spark.createDataFrame(cells, "inst long, y int, x0 int, x1 int")
    got = sorted((r.positive, r.k, r.y, r.x) for r in V.prompt_points(runs, runs.limit(0), ["inst"]).collect())
    assert got == [(True, 0, 0.5, 2.0), (True, 1, 0.0, 0.0), (True, 2, 0.0, 1.0), (True, 3, 0.0, 2.0), (True, 4, 2.0, 5.0)]


def test_masks_without_size_cells_or_image(spark):
    masks = spark.createDataFrame([(1, 10, 10), (2, None, None), (3, 10, 12), (4, 10, 10), (5, 10, 10)], "m long, height int, width int")
    images = spark.createDataFrame([(1, 10, 10), (2, 10, 10), (3, 10, 10), (5, None, None)], "m long, height int, width int")
    runs = spark.createDataFrame([(1, 0, 0, 3, 2), (2, 0, 0, 3, 9), (3, 0, 0, 3, 9), (4, 0, 0, 3, 0)], "m long, y int, x0 int, x1 int, cls int")
    assert A.mask_audit(masks, runs, images, ["m"]).first().asDict() == {"samples": 5, "unreadable": 1, "empty": 2, "mismatched": 1, "invalid": 1}
    assert A.mask_audit(masks.limit(0), runs, images, ["m"]).first().asDict() == {"samples": 0, "unreadable": 0, "empty": 0, "mismatched": 0, "invalid": 0}
