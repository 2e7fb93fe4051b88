"""What grows with the input stays spread: cells and runs are not broadcast, and results hold where rows come many times."""

import random

import pytest
from facetlake.operators import geometry as G
from facetlake.operators import groups as J
from facetlake.operators import instances as I
from facetlake.operators import overlap as O
from facetlake.operators import runs as R
from facetlake.operators import stencils as T
from facetlake.operators import views as V
from facetlake.plans import catalog, files, scenes, streams
from facetlake.sources import writers
from pyspark.sql import functions as F

CELLS = "boundary_aware_loss boundary_bce classify_by_slope mask_topology minmax_grey planarity reflect_pad resample_nearest".split()
MASKS = "erode mask_open mask_close dilate opened_plus closed_plus dilate_plus".split()
RUNS = "fuse_views instance_precision_recall merge_tiles_weighted merge_tiles_score merge_coplanar_facets mean_normals facet_points teacher_masks painted_mesh face_normals".split()


ROWS = "rasterize_polygons rasterize_concave mask_gradient".split()


def broadcast_explosions(df):
    """Broadcasts of a plan that have an exploded table below them."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [next((i for i, c in enumerate(line) if c.isalpha()), 0) for line in lines]
    found = []
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((k for k in range(at + 1, len(lines)) if depth[k] <= depth[at]), len(lines))
            found += [line] * any("Generate" in below for below in lines[at + 1 : end])
    return found


@pytest.mark.parametrize("name", CELLS + RUNS)
def test_exploded_tables_are_not_broadcast(spark, sf, name):
    assert not broadcast_explosions(catalog.queries()[name](spark, sf))


@pytest.mark.parametrize("name", CELLS + MASKS + ROWS)
def test_cells_of_a_raster_are_not_shuffled(spark, sf, name):
    """Rasters and masks are dealt before they become cells and runs: every shuffle lies below the explosion."""
    lines = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    first = max(k for k, line in enumerate(lines) if "Generate" in line) if name in MASKS + ROWS else next(k for k, line in enumerate(lines) if "Generate" in line)
    assert not [line for line in lines[:first] if "Exchange" in line]


def test_cells_become_runs_without_being_sorted(spark, sf):
    lines = catalog.queries()["runs_of_pixels"](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    cells = max(k for k, line in enumerate(lines) if "Generate explode(sequence(x0" in line)
    assert "HashAggregate" in next(line for line in reversed(lines[:cells]) if "Sort" in line or "Aggregate" in line)


def test_runs_go_on_over_the_ends_of_words(spark):
    rows = [*range(-3, 71), *range(95, 97), 99, *range(128, 160), 161]
    got = R.to_runs(spark.createDataFrame([(1, 0, x) for x in rows], "k int, y int, x long"), ["k"]).collect()
    assert sorted((r.x0, r.x1) for r in got) == [(-3, 71), (95, 97), (99, 100), (128, 160), (161, 162)]


def test_runs_of_cells_that_come_twice(spark):
    cells = spark.createDataFrame([(1, 0, x) for x in (0, 1, 1, 2, 5, 5)], "k int, y int, x int")
    assert sorted(map(tuple, R.to_runs(cells, ["k"]).collect())) == [(1, 0, 0, 3), (1, 0, 5, 6)]


def test_pairs_that_boxes_rule_out_get_no_runs(spark):
    box = lambda i, x: [(1, i, y, x, x + 10) for y in range(10)]
    runs = spark.createDataFrame(box(1, 0) + box(2, 2) + box(3, 9), "scene int, inst int, y int, x0 int, x1 int")
    pairs = lambda **k: sorted((r.a, r.b, r.inter) for r in O.instance_overlap(runs, runs, ["scene"], between=F.col("a.inst") < F.col("b.inst"), **k).collect())
    assert pairs() == [(1, 2, 80), (1, 3, 10), (2, 3, 30)] and pairs(least=2 / 3) == [(1, 2, 80)]


@pytest.mark.parametrize("name", ["simplify_polygons", "simplify_concave"])
def test_rings_are_simplified_where_they_are_dealt_to(spark, sf, name):
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_ends_at_one_place_are_one_node_without_rounds(spark, monkeypatch):
    seg = spark.createDataFrame([(1, 0, 0.0, 0.0, 4.0, 0.0), (1, 1, 4.0, 0.0, 4.0, 4.0), (1, 2, 4.0, 4.0, 0.0, 0.0)], "scene int, seg long, x1 double, y1 double, x2 double, y2 double")
    met, find = [], G.connected_components
    monkeypatch.setattr(G, "connected_components", lambda e: met.append(e.count()) or find(e))
    node, edge = G.line_graph(seg, "scene", 0.5)
    assert met == [0] and sorted(r.node for r in node.collect()) == [0, 1, 3] and sorted((r.a, r.b) for r in edge.collect()) == [(0, 1), (0, 3), (1, 3)]


@pytest.mark.parametrize("batch", [3, 10000])
def test_layers_are_painted_the_same_in_batches_of_any_size(spark, batch):
    """The value on top of each cell, ties and nulls included; the other side's runs are not painted where one side is asked for."""
    runs = [(k, y, x, x + 1 + (x * 7 + y) % 9, (x + y) % 3, None if x % 5 == 0 else (x * 11 + k) % 6) for k in range(2) for y in range(3) for x in range(0, 30, 2)]
    top = {}
    for k, y, a, b, v, r in sorted(runs, key=lambda t: (t[5] is not None, t[5] or 0, -t[2])):
        top |= {(k, y, x): v for x in range(a, b)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = R.overlay(spark.createDataFrame(runs, "k int, y int, x0 int, x1 int, v int, r int"), ["k"], "v", ["r"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.k, r.y, x): r.v for r in got for x in range(r.x0, r.x1)} == top and sum(r.x1 - r.x0 for r in got) == len(top)
    assert not {(r.k, r.y, r.x1, r.v) for r in got} & {(r.k, r.y, r.x0, r.v) for r in got}


@pytest.mark.parametrize("name", ["class_distribution", "class_weights", "query_class_weights"])
def test_the_other_side_is_not_painted(spark, sf, name):
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan[plan.index("MapInArrow") :]


@pytest.mark.parametrize("name", ["hard_samples", "mine_hard", "boundary_f1"])
def test_borders_meet_without_another_shuffle(spark, sf, name):
    """Both sides of a scene are swept together: no runs are joined, and only scenes and samples are."""
    lines = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    deep = max(k for k, line in enumerate(lines) if "Generate" in line)
    assert not [line for line in lines[lines.index(next(x for x in lines if "Generate" in x)) : deep] if "Join" in line and "y#" in line]


def test_votes_of_a_mask_add_up_over_batches(spark):
    cells = spark.createDataFrame([(k, 5 + k, x) for k in (1, 2) for x in range(40)], "mask long, y int, x int")
    found = []
    for batch in (7, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        found.append(sorted(map(tuple, V.line_segments(cells, "mask").collect())))
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and [r[:3] for r in found[0]] == [(1, 90, 6), (2, 90, 7)]


def test_a_plane_of_points_that_come_many_times(spark):
    points = [(1, float(x), float(y), 0.1 * x + 0.2 * y + 5) for x in range(10) for y in range(10)]
    got = G.fit_plane(spark.createDataFrame(points, "facet int, x double, y double, z double").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(7)))).drop("n"), "facet").collect()
    assert [(r.inliers, round(r.nx / r.nz, 6), round(r.ny / r.nz, 6)) for r in got] == [(700, -0.1, -0.2)]


def test_the_windows_still_open_count_and_scenes_share_folders(spark, sf, monkeypatch):
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert catalog.queries()["stream_log_metrics"](spark, sf).agg(F.sum("n")).first()[0] == events.count()
    folders = []
    monkeypatch.setattr(streams, "merged", lambda x: folders.extend({f.split("/merged/")[1].split("/")[0] for f in x.inputFiles()}) or x)
    streams.stream_scene_merge(spark, sf)
    assert 0 < len(folders) <= 64 and all(f.startswith("part=") for f in folders)


def test_resampling_and_padding_join_nothing(spark):
    cells = spark.createDataFrame([(1, y, x, float(3 * y + x)) for y in range(3) for x in range(3)], "k int, y int, x int, z double")
    for n in (1, 2, 3, 4, 7):
        near = {(r.y, r.x): r.z for r in T.resample_nearest(cells, ["k"], 3, 3, n, 5).collect()}
        assert near == {(y, x): float(3 * (y * 3 // n) + x * 3 // 5) for y in range(n) for x in range(5)}
    wide = {(r.y, r.x): r.z for r in R.reflect_pad(cells, ["k"], 3, 3, 8).collect()}
    back = [0, 1, 2, 1, 0, 1, 2, 1]
    assert wide == {(y, x): float(3 * back[y] + back[x]) for y in range(8) for x in range(8)}


def test_height_pairs_take_as_many_tasks_as_their_cells_need(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(writers, "TASK_CELLS", 16)
    pairs = spark.createDataFrame([(str(k), "i", "h", "m") for k in range(20)], "sample_id string, image_path string, dsm_path string, mask_path string")
    heights = spark.createDataFrame([(str(k), y, x, float(x)) for k in range(20) for y in range(4) for x in range(4)], "sample_id string, y int, x int, z double")
    found = writers.write_height_pairs(pairs, heights, str(tmp_path)).collect()
    assert len(found) == 20 and {r.cells for r in found} == {16}
    assert len(list((tmp_path / "normal").glob("part-*.parquet"))) > 4


def traced(spark, rows):
    runs = spark.createDataFrame(rows, "k int, y int, x0 int, x1 int")
    out = {}
    for r in R.rings(R.outline(runs, ["k"]), ["k"]).collect():
        out.setdefault((r.k, r.ring), {})[r.ord] = (r.x, r.y)
    assert all(sorted(v) == list(range(len(v))) for v in out.values())
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


def test_rings_inside_a_block_need_no_rounds(spark, monkeypatch):
    written, write = [], R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, name="table": written.append(name) or write(df, name))
    teeth = [(1, y, 0, 20 - y % 2) for y in range(60)]
    got = traced(spark, teeth + [(1, 70, 0, 1), (1, 71, 1, 2)])
    assert sorted(map(len, got.values())) == [4, 4, 122] and len(written) == 1


def test_rings_over_many_blocks(spark):
    """A comb as high as five blocks with a hole over three of them, and cells that touch at corners on both sides of a block's border."""
    comb = [(1, y, 0 if y % 2 else 1, x) for y in range(600) for x in [40 + y % 3]]
    holed = [(k, y, *s) for k, y, x0, x1 in comb for s in ([(x0, 10), (12 + y % 2, x1)] if 100 <= y < 400 else [(x0, x1)])]
    corners = [(2, y, y % 2, y % 2 + 1) for y in range(120, 136)] + [(2, 300, 0, 1)]
    got = traced(spark, holed + corners)
    area = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True)) / 2
    cells = sum(x1 - x0 for _, _, x0, x1 in holed)
    outer, hole = got[1, 0], got[1, 1]
    assert len([k for k in got if k[0] == 1]) == 2 and area(outer) + area(hole) == cells and area(hole) < 0 < area(outer)
    assert all((a[0] == b[0]) != (a[1] == b[1]) for r in got.values() for a, b in zip(r, r[1:] + r[:1], strict=True))
    assert all(min(range(len(r)), key=lambda i: r[i][::-1]) == 0 for r in got.values())
    assert [area(r) for k, r in sorted(got.items()) if k[0] == 2] == [1.0] * 17


def test_corners_are_looked_up_in_tasks_that_their_number_sets(spark, monkeypatch):
    """However few partitions or bytes Spark would take, each look-up is dealt by the number of corners."""
    monkeypatch.setattr(G, "TASK_CORNERS", 7, raising=False)
    v = spark.range(40).selectExpr("id div 4 AS mesh", "id % 4 AS vid", "double(id % 2) AS x", "double(id % 4 div 2) AS y", "double(id % 5) AS z")
    f = spark.range(20).selectExpr("id div 2 AS mesh", "id % 2 AS fid", "id % 2 AS a", "id % 2 * 2 + 1 AS b", "id % 1 + 2 AS c")
    got = G.face_normals(f, v)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 6 and "ENSURE_REQUIREMENTS" not in plan and got.count() == 20


def test_layers_are_painted_where_they_are_dealt_to(spark, sf):
    plan = scenes.labels(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Generate") == 1


def test_areas_of_components_over_blocks_and_inside(spark):
    rows = [(1, y, 0, 2) for y in range(300)] + [(1, y, 10, 14) for y in range(5)] + [(2, y, 0, 1) for y in range(127, 130)]
    got = R.run_components(spark.createDataFrame(rows, "k int, y int, x0 int, x1 int"), ["k"], area=True).collect()
    assert sorted({(r.k, r.x0, r.area) for r in got}) == [(1, 0, 600), (1, 10, 20), (2, 0, 3)]
    assert len({r.component for r in got}) == 3


def test_blocks_are_dealt_by_the_number_of_runs(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_RUNS", 100, raising=False)
    tasks, write = [], R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, name="table": tasks.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    R.run_components(spark.createDataFrame([(k, y, 0, 2) for k in range(20) for y in range(50)], "k int, y int, x0 int, x1 int"), ["k"])
    plan = dict(tasks)["nodes"]
    assert plan.count("Exchange") == 1 and "10), REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("name", ["mask_polygons", "mask_rings"])
def test_masks_become_rings_in_the_task_that_they_are_dealt_to(spark, sf, monkeypatch, name):
    plans, write = {}, R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, name="table": write(plans.setdefault(name, df), name))
    catalog.queries()[name](spark, sf)
    lines = plans["corners"]._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [line for line in lines[: max(k for k, line in enumerate(lines) if "Generate" in line)] if "Exchange" in line]


def test_rings_as_rows_are_the_rings(spark):
    """Inside a block, over several blocks, with a hole and with a corner contact."""
    tall = [(1, y, *s) for y in range(300) for s in ([(0, 5), (9, 20 + y % 2)] if 100 <= y < 250 else [(0, 20 + y % 2)])]
    edges = R.outline(spark.createDataFrame(tall + [(1, 0, 30, 32), (1, 1, 32, 33), (2, 5, 0, 3)], "k int, y int, x0 int, x1 int"), ["k"])
    rows, number = R.ring_rows(edges, ["k"])
    got = G.corners_of(rows.join(number, ["k", "low"]), ["k", "ring"])
    want = R.rings(edges, ["k"])
    assert got.schema.simpleString() == want.schema.simpleString() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {(r.k, r.ring): r.area for r in rows.join(number, ["k", "low"]).select("k", "ring", G._signed_area(F.col("r")).alias("area")).collect()} == {
        (r.k, r.ring): r.signed for r in G.polygon_measures(want, ["k", "ring"]).collect()
    }


def test_corners_find_their_nearest_line_where_they_meet_the_lines(spark):
    v = spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 1, 64.5, 63.0), (1, 2, 90.0, 90.0), (2, 0, 1.0, 1.0)], "scene int, ord int, x double, y double")
    seg = spark.createDataFrame([(1, 5, 0.0, 3.0, 200.0, 3.0), (1, 6, 3.0, 0.0, 3.0, 9.0), (1, 7, 60.0, 66.0, 70.0, 66.0), (1, 8, 66.0, 40.0, 66.0, 66.0)], "scene int, seg int, x1 double, y1 double, x2 double, y2 double")
    x = G.snap_to_lines(v, seg, "scene", 4.0)
    assert x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert sorted(map(tuple, x.collect())) == [(1, 0, 1.0, 3.0), (1, 1, 66.0, 63.0), (1, 2, 90.0, 90.0), (2, 0, 1.0, 1.0)]


def drawn(seed, keys=3, n=25):
    """Runs of scored rectangles with a notch, some of them alike."""
    rng = random.Random(seed)
    rows = []
    for inst in range(keys * n):
        y, x = (rng.randrange(0, 12), rng.randrange(0, 12)) if inst % 3 else (inst % 5, inst % 4)
        for d in range(rng.randrange(6, 9)):
            rows.append((inst // n, 0, inst, float(5 + inst * 31 % 90), y + d, x, x + 6 + d % 2))
            if d == 2:
                rows.append((inst // n, 0, inst, float(5 + inst * 31 % 90), y + d, x + 9, x + 11))
    return rows


@pytest.mark.parametrize(("method", "inclusive"), [("score", False), ("union", True), ("weighted", False)])
def test_merged_in_tasks_by_joins_and_in_part(spark, monkeypatch, method, inclusive):
    """Keys of few runs are merged in their task, keys of many by joins: the cells are the same, however many keys go each way."""
    rows = drawn(7) + [(None, 0, 900, 50.0, 1, 0, 9), (None, 0, 901, 60.0, 1, 0, 9)]
    runs = spark.createDataFrame(rows, "scene int, label int, inst long, score double, y long, x0 long, x1 long")
    got = {}
    for most in (1 << 16, 195, 0):
        monkeypatch.setattr(J, "MOST_RUNS", most)
        found = I.merge_instances(runs.where("scene is not null"), ["scene", "label"], method, 0.4, inclusive).collect()
        got[most] = sorted((r.scene, r.cluster, r.members, r.score, r.y, x) for r in found for x in range(r.x0, r.x1))
    assert got[1 << 16] == got[195] == got[0] and any(r[2] > 1 for r in got[0])
    monkeypatch.setattr(J, "MOST_RUNS", 1 << 16)
    alone = I.merge_instances(spark.createDataFrame(rows[-2:], runs.schema), ["scene", "label"], method, 0.4).collect()
    assert sorted((r.cluster, r.members) for r in alone) == [(900, 1), (901, 1)]


def test_detections_of_a_stream_are_merged_without_a_join(spark, tmp_path):
    """Tables in files say little about their size in memory: nothing of them is broadcast, and equal keys need no pairs in a shuffle."""
    spark.createDataFrame(drawn(3), "scene int, label int, inst long, score double, y long, x0 long, x1 long").write.parquet(str(tmp_path / "runs"))
    plan = I.merge_instances(spark.read.parquet(str(tmp_path / "runs")), ["scene", "label"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["merge_tiles_weighted", "fuse_views", "merge_tiles_score", "merge_tiles_union"])
def test_instances_are_merged_where_they_are_dealt_to(spark, sf, name):
    """One shuffle by scene, and one of the sums of merged instances."""
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "Join" not in plan


def test_scores_that_are_no_votes_in_whole_steps_go_through_joins(spark):
    rows = [(1, i, s, 0, 0, x) for i, s, x in ((1, 1e9, 10), (2, 3e9, 8), (3, None, 9))]
    runs = spark.createDataFrame(rows, "scene int, inst long, score double, y long, x0 long, x1 long")
    assert [(r.members, r.score, r.x0, r.x1) for r in I.merge_instances(runs, ["scene"], "weighted").collect()] == [(3, 3e9, 0, 8)]


def test_coplanar_facets_are_merged_where_their_scene_is_dealt_to(spark, sf):
    lines = catalog.queries()["merge_coplanar_facets"](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    deep = max(k for k, line in enumerate(lines) if "Generate explode(sequence" in line)
    assert sum("Exchange" in line for line in lines[:deep]) <= 1 and not [line for line in lines[:deep] if "Join" in line]


def test_facets_that_touch_and_lie_in_one_plane(spark, monkeypatch):
    """Shared cells, a stretch of border, a corner alone, another plane and a facet without a normal; in a task and by joins."""
    up, side = (0.0, 0.0, 1.0), (0.6, 0.0, 0.8)
    boxes = [(1, up, 0, 0), (2, up, 2, 2), (3, up, 2, 6), (4, up, 6, 10), (5, side, 4, 0), (6, (None,) * 3, 0, 0), (7, up, 20, 20), (8, up, 24, 20)]
    rows = [(1, i, *n, y + d, x, x + 4) for i, n, y, x in boxes for d in range(4)] + [(2, 9, *up, 0, 0, 4)]
    runs = spark.createDataFrame(rows, "scene int, inst long, nx double, ny double, nz double, y long, x0 long, x1 long")
    for most in (1 << 16, 10, 0):
        monkeypatch.setattr(J, "MOST_RUNS", most)
        found = G.merge_coplanar(runs, "scene").collect()
        members, cells = {}, {}
        for r in found:
            members.setdefault(r.grp, set()).update(r.members)
            cells[r.grp] = cells.get(r.grp, 0) + sum(x.x1 - x.x0 for x in r.runs)
        assert members == {1: {1, 2, 3}, 4: {4}, 5: {5}, 6: {6}, 7: {7, 8}, 9: {9}}
        assert cells == {1: 44, 4: 16, 5: 16, 6: 16, 7: 32, 9: 4}


@pytest.mark.parametrize("name", ["prompt_points", "prompt_ring", "outline_area"])
def test_rings_and_points_of_masks_are_made_where_scenes_are_dealt_to(spark, sf, monkeypatch, name):
    """Nothing is written down, and no run is shuffled."""
    monkeypatch.setattr(scenes, "materialize", lambda df, name="table": pytest.fail(name))
    lines = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert all("REPARTITION_BY_NUM" in line or "Reused" in line for line in lines if "Exchange" in line)


def test_annotation_documents_hold_many_scenes_and_are_made_where_they_are_dealt_to(spark, sf, monkeypatch):
    """As many files as documents and not as scenes; with several documents the rows are the same."""
    want = {r.id: r for r in catalog.queries()["coco_documents"](spark, sf).collect()}
    assert len(want) == 30 and len(catalog.queries()["coco_documents"](spark, sf).inputFiles()) == 1
    monkeypatch.setattr(files, "DOCUMENT_SCENES", 8)
    some = catalog.queries()["coco_documents"](spark, sf)
    assert len(some.inputFiles()) == 4 and {r.id: r for r in some.collect()} == want
    plan = files.annotation_documents(spark, sf, "label", 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
